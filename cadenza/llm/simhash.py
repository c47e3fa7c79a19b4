"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two halves. Two fingerprints within 3 bits differ by at most one
bit in one of the halves, so each half is looked up in a table of all halves together with the
values one bit away, and what is met is verified on all 64 bits. Documents of equal fingerprints
are one fingerprint from the start. A half that many fingerprints share is split into blocks of
bounded size; a block passes on a spanning set of links, never all pairs.

Defined results:
- A text without words, missing or empty, has fingerprint 0 and is linked like any other. The words of
  one text are held at once, as many as it has.
- A missing doc_id is kept; component_id is the smallest doc_id that is there, or missing if none is.
- Rows that share a doc_id are rows of their own, each with the component of its own fingerprint.
- An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, row_of, utf8
from cadenza.llm.components import components
from cadenza.session import cut, send_with_tasks

SEED = 42
HALF = 32
AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of a text in UTF-8: bit i is set if over half of its shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), AT_ONCE):
        part = hashes[start : start + AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint of every row as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column(2).to_pylist()]
            signed = pa.array(np.array(found, dtype="<u8").view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed], schema=schema)

    row_id, row_hash = row_of(id_col, text_col)
    rows = docs.select(row_id.cast("long").alias("doc_id"), row_hash, utf8(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _halves(fps: DataFrame, values: str) -> DataFrame:
    """fp, key for every value that the expression `values` makes of a half `v`."""
    both = fps.select("fp", F.expr(f"explode(array(struct(0L as s, fp & {2**HALF - 1}L as v), struct(1L as s, shiftrightunsigned(fp, {HALF}) as v)))").alias("half"))
    each = both.select("fp", F.col("half.s").alias("s"), F.col("half.v").alias("v"))
    return each.select("fp", "v", "s", F.explode(F.expr(values)).alias("w")).select(
        "fp", F.expr("w * 2 + s").alias("key"), (F.col("v") == F.col("w")).alias("same")
    )


def candidate_blocks(fps: DataFrame, block: int) -> DataFrame:
    """key, part, probe, fp: table rows (probe false) and look-ups (probe true) that meet.

    A key held by n fingerprints has ceil(n / block) parts; look-ups visit all of them. Of two
    values one bit apart, only the smaller one looks up the other.
    """
    kept = _halves(fps, "array(v)").select("fp", "key")
    # Counts are written before they are joined, so that joins can split a very common key.
    counts = cut(kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    near = "filter(transform(sequence(-1, 31), i -> if(i < 0, v, v | shiftleft(1L, i))), (w, i) -> i = 0 or w != v)"
    asked = _halves(fps, near).join(counts, "key").filter(~F.col("same") | (F.col("n") > 1))
    parts = F.ceil(F.col("n") / block).cast("int")
    asked = cut(asked.select("key", "fp", "n"))
    visits = asked.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("probe"), "fp")
    wanted = cut(asked.groupBy("key").agg(F.first("n").alias("n")))
    home = F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int").alias("part")
    return visits.unionByName(kept.join(wanted, "key").select("key", home, F.lit(False).alias("probe"), "fp"))


def _spanning(members: np.ndarray, probes, most: int):
    """Links (a, b) that connect what the pairs within `most` bits of members and probes connect."""
    groups = np.arange(len(members))
    for probe in probes:
        met = np.flatnonzero(np.bitwise_count((members ^ probe).view(np.uint64)) <= most)
        if not len(met):
            continue
        found = groups[met]
        firsts = [0, *(np.argmax(found == label) for label in np.unique(found[found != found[0]]))]
        for at in firsts:
            if members[met[at]] != probe:
                yield int(probe), int(members[met[at]])
            groups[groups == found[at]] = found[0]


def links(fps: DataFrame, most: int = 3, block: int = 1024) -> DataFrame:
    """a, b: links between fingerprints that connect all that lie within `most` bits. most <= 3."""
    if not 0 <= most <= 3:
        raise ValueError("two halves find pairs of up to 3 differing bits")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        def found():
            group, members, held = None, [], None
            for batch in batches:
                keys, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                probes, values = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
                turns = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1
                for start, end in zip([0, *turns], [*turns, len(keys)]):
                    if (keys[start], parts[start]) != group:
                        group, members, held = (keys[start], parts[start]), [], None
                    own, asked = values[start:end][~probes[start:end]], values[start:end][probes[start:end]]
                    if len(own):
                        members.append(own)
                    if len(asked):
                        # Members come first, so they are complete once look-ups begin.
                        held = np.concatenate(members) if held is None and members else held
                        if held is not None:
                            yield from _spanning(held, asked, most)

        yield from batches_of(found(), schema, 50_000)

    dealt = candidate_blocks(fps, block).repartition("key", "part").sortWithinPartitions("key", "part", "probe")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    most: int = 3,
    block: int = 1024,
    named: bool = False,
) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that can be reached over links.

    `named` adds text_hash and root, a fingerprint that names the group also where ids are missing.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), most, block))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    met = rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")
    return met.select("doc_id", "fp", "component_id", *(["text_hash", "root"] if named else []))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3, block: int = 1024
) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id, columns as they were.

    Of rows that share that doc_id, and of those without any, the one with the smallest hash of its
    text stays; of equal ones, any.
    """
    found = near_duplicates(docs, id_col, text_col, width, most, block, named=True)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = found.groupBy("root").agg(F.min(order).alias("first")).select(
        F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash")
    )
    # Missing ids as the smallest number, so that rows meet by plain keys.
    none = F.lit(-(2**63)).cast("long")
    row_id, row_hash = row_of(id_col, text_col)
    kept = kept.select(F.coalesce("__id", none).alias("__id"), "__hash")
    marked = docs.withColumn("__id", F.coalesce(row_id.cast("long"), none)).withColumn("__hash", row_hash)
    held = marked.join(kept, ["__id", "__hash"], "left_semi")
    # Rows that are equal in id and text; all others are alone in their group.
    return held.dropDuplicates(["__id", "__hash"]).select(*docs.columns)


def hex_of(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


send_with_tasks(__name__)
