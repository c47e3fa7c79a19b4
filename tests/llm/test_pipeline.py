"""The pipeline, stage by stage, against plain versions on each stage's own input."""

import os
import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline as cp
from cadenza.llm import kneser_ney, queries, toxicity
from cadenza.session import new_path
from tests.llm import cases
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_toxicity import LABELS, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    toxic_rows, toxic_labels = corpus()
    rows = toxic_rows + [(1000 + d if d is not None else None, *r) for d, *r in cases.documents()]
    rows += [(5000 + i, "".join(chr(rng.randint(33, 126)) for _ in range(400)), "en", "s", 0) for i in range(8)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    cases.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(toxic_labels + [(None, 1, 1), (99_999, 0, 1)], LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_every_stage(spark, folder):
    docs, path = queries.table(spark, folder, "documents"), None
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, stage in cp.STAGES:
        before = rows_of(docs)
        path = new_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        kept = spark.read.parquet(path)
        if name != "best-fit packing":
            assert kept.columns == cp.COLUMNS
            after = rows_of(kept)
        if name == "toxicity":
            model = toxicity.train(docs, toxicity.learn_labels(queries.table(spark, folder, "labels")))
            scores = [r.toxicity for r in toxicity.scored(docs, model).select(*cp.COLUMNS, "toxicity").collect()]
            assert sorted(after, key=repr) == sorted((r for r, s in zip(before, scores) if s < 0.5), key=repr)
            assert len(after) < len(before) - 90
        elif name == "quality classifier":
            judged = kneser_ney.judge(docs, queries.trusted_ids(spark, folder)).collect()
            out = {r.doc_id for r in judged if not r.kept}
            assert {r[0] for r in before} - {r[0] for r in after} <= out and len(after) == sum(r.kept for r in judged)
        elif name == "line dedup":
            expected = {(d, t) for d, _, _, t in plain_lines(before)}
            assert {(r[0], r[1]) for r in after} == expected and len(after) == len(before)
            assert all(r[4] == len(r[1]) for r in after)
        elif name == "simhash near-dedup":
            roots = plain_components([plain_fingerprint(r[1]) for r in before])
            groups = {}
            for r, root in zip(before, roots):
                groups.setdefault(root, []).append(r[0])
            least = [min(ids, key=lambda d: (d is None, d or 0)) for ids in groups.values()]
            assert sorted((r[0] for r in after), key=repr) == sorted(least, key=repr)
        else:
            expected = []
            for doc_id, text, *_ in before:
                ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
                for piece, at in enumerate(range(0, len(ids), 4096)):
                    part = ids[at : at + 4096]
                    expected.append((doc_id, piece, at, len(part), crc32(part.tobytes())))
            got = kept.select("doc_id", "piece", "start", "length", "ids_crc32").collect()
            assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
        docs = kept


def test_run_gives_the_rows_of_the_stages(spark, folder):
    docs = queries.table(spark, folder, "documents")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, cp.run(spark, folder).select(*key).collect()), key=repr) == sorted(map(tuple, docs.select(*key).collect()), key=repr)


def test_empty_tables(spark, tmp_path):
    cases.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = entry_module.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_held_out_toxicity_on_the_test_data(spark):
    rows = queries.op1_toxicity(spark, "/root/testdata/sf0.1").join(queries.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id")
    held = rows.filter("held_out").select("toxic", "predicted").toPandas()
    assert held.predicted[held.toxic == 1].mean() > 0.85 and held.predicted[held.toxic == 0].mean() < 0.01
