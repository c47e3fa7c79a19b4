"""Document fingerprints as a homomorphic multiset hash.

Every piece of every paragraph is hashed to a wide vector of +1 and -1. A fingerprint is the sum of
the vectors modulo 2**64, so it does not depend on the order of the pieces, and a piece is inserted
or deleted by adding or subtracting its vector. Different multisets meet with a chance of about
2**-256 at most, as no text has 2**63 equal pieces. The same sums estimate how alike two texts are: the product of two fingerprints,
taken as signed numbers, is on average the number of pieces they share.

A paragraph is a line. It is cut into pieces after words whose checksum is a multiple of CUT, which
depends on the word alone, so an edit changes only the pieces around it; a stretch without such a
word is cut after every MOST_WORDS words.

Defined results:
- A missing text is empty. A text without words has the zero vector. The words of one text are held
  at once, as many as it has.
- "Next" is the next row by (doc_id, text), missing values first; after the last row comes the first.
  Rows that share a doc_id follow each other by text. With a single row, the next one is itself.
- An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, rows_in
from cadenza.session import send_with_tasks

LANES = 256
CUT = 4
MOST_WORDS = 8
AT_ONCE = 1 << 14


def pieces(text: bytes) -> list[bytes]:
    """The pieces of all paragraphs. Joined by blanks, those of a paragraph are the paragraph."""
    found = []
    for paragraph in text.split(b"\n"):
        if not paragraph:
            continue
        words = paragraph.split(b" ")
        start = 0
        for end in [*[i for i, word in enumerate(words, 1) if not crc32(word) % CUT], len(words)]:
            for first in range(start, end, MOST_WORDS):
                found.append(b" ".join(words[first : min(end, first + MOST_WORDS)]))
            start = end
    return found


def lanes_of(elements: list[bytes]) -> np.ndarray:
    """The sum of the vectors of all elements, modulo 2**64."""
    ones = np.zeros(LANES, dtype=np.int64)
    for start in range(0, len(elements), AT_ONCE):
        part = elements[start : start + AT_ONCE]
        digests = b"".join([hashlib.blake2b(e, digest_size=LANES // 8).digest() for e in part])
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(len(part), -1), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return (2 * ones - len(elements)).astype(np.uint64)


def fingerprint(text: bytes) -> np.ndarray:
    return lanes_of(pieces(text))


def inserted(lanes: np.ndarray, elements: list[bytes]) -> np.ndarray:
    return lanes + lanes_of(elements)


def deleted(lanes: np.ndarray, elements: list[bytes]) -> np.ndarray:
    return lanes - lanes_of(elements)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the estimated cosine of the two multisets, 0 to 1."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a.view(np.int64).astype(np.float64), b.view(np.int64).astype(np.float64)
    size = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def hex_of(lanes: np.ndarray) -> str:
    return lanes.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of a text, replaced by as much of the beginning of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """part, borrowed, doc_id, text: runs of ids, each followed by the first row of the next run.

    Split points come from all ids, so runs hold about equally many rows; only ids are read for it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    steps = [i / parts for i in range(1, parts)]
    splits = ids.approxQuantile("doc_id", steps, 0.1 / parts) if steps else []
    points = [float("-inf"), *sorted(set(splits)), float("inf")]
    numbers = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))

    def placed(df):
        if len(points) < 3:
            return df.withColumn("part", F.lit(0))
        dealt = Bucketizer(splits=points, inputCol="__number", outputCol="__run").transform(df.withColumn("__number", numbers))
        return dealt.withColumn("part", F.col("__run").cast("int")).drop("__number", "__run")

    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))
    # One row for every run: at most `parts` of them, here and in the broadcast.
    found = sorted((r.part, r.start.doc_id) for r in placed(ids).groupBy("part").agg(least.alias("start")).collect())
    lent = [(start, found[i - 1][0]) for i, (_, start) in enumerate(found)]
    starts = docs.sparkSession.createDataFrame(lent, "start long, lent int")
    own = F.struct("part", F.lit(False).alias("borrowed"))
    copy = F.struct(F.col("lent").alias("part"), F.lit(True).alias("borrowed"))
    places = F.when(F.col("lent").isNull(), F.array(own)).otherwise(F.array(own, copy))
    met = placed(rows).join(F.broadcast(starts), F.col("doc_id").eqNullSafe(F.col("start")), "left")
    return met.select(F.explode(places).alias("place"), "doc_id", "text").select("place.*", "doc_id", "text")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
         ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def judged(doc_id, text, lanes, following, next_lanes):
        changed = edited(text, following).encode()
        changed_lanes = fingerprint(changed)
        return (
            doc_id, len(text), hashlib.sha256(changed).hexdigest(), hex_of(lanes), hex_of(changed_lanes),
            likeness(lanes, changed_lanes), likeness(lanes, next_lanes),
        )

    def run(batches):
        def found():
            held = None
            for part, borrowed, doc_id, text in rows_in(batches):
                if held and held[0] == part:
                    lanes = fingerprint(text.encode())
                    yield judged(*held[1:], text, lanes)
                    held = None if borrowed else (part, doc_id, text, lanes)
                elif not borrowed:
                    held = (part, doc_id, text, fingerprint(text.encode()))

        yield from batches_of(found(), schema, 500)

    placed = with_next(docs, id_col, text_col, parts)
    dealt = placed.repartition(parts, "part").sortWithinPartitions("part", "borrowed", "doc_id", "text")
    return dealt.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


send_with_tasks(__name__)
