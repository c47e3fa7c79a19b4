import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm import warc
from tests.llm import cases

SCHEMA = "page_id long, url string, html string, digest string, payload string, archive string, record string"


def pages():
    rng = random.Random(1)
    long = cases.sentence(rng, 400)
    rows = [(i, f"http://x/{i}", cases.sentence(rng, rng.randint(0, 300)), *"dpar") for i in range(30)]
    rows += [(100 + i, f"http://x/{i}", long, *"dpar") for i in range(5)]
    rows += [(200 + i, None, "short text", *"dpar") for i in range(3)]
    rows += [
        (300, None, None, *"dpar"), (301, "http://x/\r\nInjected: 1", "", *"dpar"), (302, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90, *"dpar"),
        (303, "é", "ü" * 600, *"dpar"), (304, "é", "ü" * 600, *"dpar"), (304, "é", "ü" * 600, *"dpar"),
        (None, "n", "ü" * 600, *"dpar"), (None, "n", "x" * 2000, *"dpar"), (None, "n", "x" * 2000, *"dpar"),
        (305, "u", "y" * 999, *"dpar"), (306, "u", "y" * 999, *"dpar"), (307, "u", "z" * 300_000, *"dpar"),
    ]
    return rows


def plain(rows, least=1000):
    largest = {}
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= least and page_id is not None:
            largest[data] = max(page_id, largest.get(data, page_id))
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        kept = largest.get(data, page_id)
        revisit = kept != page_id
        digest = hashlib.sha1(data).hexdigest()
        out.append((page_id, len(data), digest, "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [7, 300, 1 << 20])
def test_round_trip(spark, chunk):
    rows = [r for r in pages() if chunk > 7 or len(r[2] or "") < 5000]
    back = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk)
    assert sorted((tuple(r)[:5] for r in back.collect()), key=repr) == plain(rows)


def written(spark, tmp_path, chunk=300):
    path = str(tmp_path / "archive")
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(2), path, chunk=chunk)
    return path, spark.read.parquet(path)


def test_archives_are_warc_files(spark, tmp_path):
    _, chunks = written(spark, tmp_path)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 300
    rows = chunks.orderBy("archive", "record", "chunk").collect()
    records = {}
    for r in rows:
        records[r.archive, r.record] = records.get((r.archive, r.record), b"") + bytes(r.data)
    types = []
    for data in records.values():
        head, body = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.1" and "Injected" not in fields
        assert body[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        types.append(fields["WARC-Type"])
        assert ("WARC-Refers-To" in fields) == (types[-1] == "revisit")
    assert len(records) == len(pages()) and {*types} == {"response", "revisit"}


def test_damage_is_noticed(spark, tmp_path):
    path, chunks = written(spark, tmp_path)
    several = chunks.filter("chunk = 1 AND NOT last").select("archive", "record").first()
    here = (F.col("archive") == several.archive) & (F.col("record") == several.record)
    changed = F.when(here & (F.col("chunk") == 1), F.lit(b"x" * 300)).otherwise(F.col("data"))
    for broken in (
        chunks.filter(~(here & (F.col("chunk") == 1))),
        chunks.filter(~(here & F.col("last"))),
        chunks.withColumn("data", changed),
        chunks.unionByName(chunks.filter(here & (F.col("chunk") == 0))),
    ):
        with pytest.raises(Exception, match="chunk is missing|cut off|repeated"):
            warc.read_chunks(broken).collect()
    assert warc.read_archives(spark, path).count() == len(pages())


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
