import hashlib
import random
from collections import defaultdict

from cadenza.llm import line_dedup as ld
from tests.llm import cases


def plain(rows, least_docs=3, least_chars=20):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    largest = {k: max(ids, key=lambda d: (d is not None, d or 0)) for k, ids in holders.items()}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or largest[key(x)] == doc_id
        ]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(spark, rows, **limits):
    cut = ld.drop_repeated_lines(cases.frame(spark, rows), **limits)
    return sorted((tuple(r) for r in cut.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


def test_awkward_documents(spark):
    rows = cases.documents()
    assert found(spark, rows) == plain(rows)


def test_random_lines(spark):
    rng = random.Random(5)
    pool = [f"{rng.choice('ÄaAé')} line number {i} with enough characters" for i in range(40)] + ["short", "", " "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 200))), "en", "s", 0) for i in range(80)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, least_docs=2, least_chars=1) == plain(rows, 2, 1)


def test_upper_case_outside_of_a_to_z_counts(spark):
    rows = [(i, line, "en", "s", 0) for i, line in enumerate(["ÄRGER in this long line of text", "ärger in this long line of text"] * 2)]
    assert [r[2] for r in found(spark, rows)] == [0, 0, 0, 0]


def test_bitmaps_leave_out_words_without_dropped_lines(spark):
    line = "a line that three documents share, and more"
    long = "\n".join([f"own line {i}" for i in range(200)] + [line])
    rows = [(1, long, "en", "s", 0), (2, line, "en", "s", 0), (3, line, "en", "s", 0)]
    maps = {r.doc_id: r.keep for r in ld.keep_bitmaps(cases.frame(spark, rows)).collect()}
    assert [(e.word, e.bits) for e in maps[1]] == [(3, ~(1 << 8))]
    assert set(maps) == {1, 2}


def test_other_columns_stay_and_an_empty_table_is_empty(spark):
    rows = cases.documents()
    cut = ld.drop_repeated_lines(cases.frame(spark, rows))
    assert {*cases.CLASHES} <= {*cut.columns}
    assert {r.keep for r in cut.collect()} == {None if r[0] is None else f"own {r[0]}" for r in rows}
    assert ld.drop_repeated_lines(cases.frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    cut = ld.drop_repeated_lines(cases.frame(spark, cases.documents()))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hash_of_the_kept_text(spark):
    from pyspark.sql import functions as F

    cut = ld.drop_repeated_lines(cases.frame(spark, [(1, "é\nb", "en", "s", 0)]))
    row = cut.select(F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")).first()
    assert row.h == hashlib.sha256("é\nb".encode()).hexdigest()
