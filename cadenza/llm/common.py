"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import send_with_tasks

# The white space that separates words.
BLANKS = " \t\n\x0b\x0c\r"
SMALL_ROWS = 100_000
PARTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The bytes of a text; a missing text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def row_of(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart where ids repeat: the id and a hash of the text."""
    return [F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")]


def kept_by_worker(key, make: Callable):
    """make(), made once per Python worker for as long as its tasks ask for the same key.

    The functions of a task arrive with globals of their own each time, so what a worker keeps lies
    in a module that only names it. One thing is kept, so memory does not add up over stages.
    """
    store = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if store.get("key") != key:
        store["key"], store["value"] = None, None
        store["value"] = make()
        store["key"] = key
    return store["value"]


def stretches(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in stretches of about `size` bytes, cut after white space only."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end - 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most `most` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def join_small(
    rows: DataFrame, small: DataFrame, keys: list[str], spread: list[str], missing: bool = True
) -> DataFrame:
    """rows LEFT JOIN small on keys, none of which may gather in one task; `missing`: keys may be missing.

    small goes to all tasks if it has been counted and found small; beyond that, every key is split
    into parts by the columns `spread`, which tell rows of one key apart.
    """
    renamed = small.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in small.columns])
    meets = Column.eqNullSafe if missing else Column.__eq__
    on = [meets(F.col(k), F.col(f"__{k}")) for k in keys]
    if renamed.count() <= SMALL_ROWS:
        right = F.broadcast(renamed)
    else:
        rows = rows.withColumn("__part", F.pmod(F.xxhash64(*spread), F.lit(PARTS)))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
        right = renamed.withColumn("__copy", copies)
        on.append(F.col("__part") == F.col("__copy"))
    joined = rows.join(right, reduce(Column.__and__, on), "left")
    return joined.drop(*[f"__{k}" for k in keys], "__part", "__copy")


def with_columns_replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; one of the same name in df, in any case, is replaced."""
    taken = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


send_with_tasks(__name__)
