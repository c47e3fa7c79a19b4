"""Tables laid out by value, with the bounds of every file, so that a filter opens few files.

Rows lie in ranges of some columns, or of several values at once whose ranks are interleaved bit by
bit. For every file the smallest and largest value of the bounded columns are kept. A filter is held
against these first, and only files that can hold a passing row are read. A value that very many
rows share spans several files, as the order ends with a column that tells rows apart.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 20_000
# Ranks of a value have so many bits: 2 ** RANK_BITS ranges with about as many rows each.
RANK_BITS = 8

# For each column the ranges of which a value must lie in one, ends included; None is an open end.
Ranges = Mapping[str, Iterable[tuple[object, object]]]


def files_for(spark: SparkSession, n_rows: int, per_file: int = ROWS_PER_FILE) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // per_file))


def save(rows: DataFrame, path: str, by: list[str], files: int, bounded: list[str], leave_out: Iterable[str] = ()) -> None:
    """Write rows in ranges of `by`, without the columns of `leave_out`, and the bounds of every file.

    A write is a folder of its own; the layout, written last, names the one that counts.
    """
    spark = rows.sparkSession
    home = f"{path}/{uuid.uuid4().hex}"
    placed = rows.repartitionByRange(files, *by).sortWithinPartitions(*by).drop(*leave_out)
    placed.write.parquet(f"{home}/data")
    written = spark.read.schema(placed.schema).parquet(f"{home}/data")
    ends = [f(F.col(f"`{c}`")).alias(f"{tag}_{i}") for i, c in enumerate(bounded) for tag, f in (("low", F.min), ("high", F.max))]
    found = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), *ends)
    found.coalesce(1).write.parquet(f"{home}/bounds")
    layout = {"home": home, "bounded": bounded, "schema": placed.schema.json()}
    one = spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1)
    one.write.mode("overwrite").text(f"{path}/layout")


def _cuts(rows: DataFrame, values: list[str]) -> list[list[float]]:
    """For each value what parts its rows into 2 ** RANK_BITS ranges; none where all are null."""
    shares = [i / (1 << RANK_BITS) for i in range(1, 1 << RANK_BITS)]
    asked = [F.percentile_approx(F.col(f"`{v}`").cast("double"), shares, 10_000).alias(f"c{i}") for i, v in enumerate(values)]
    return [sorted(set(held or [])) for held in rows.agg(*asked).first()]


def _rank(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below a value; 0 for null."""
    below = F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < value)
    return F.greatest(F.size(below), F.lit(0))


def _interleaved(ranks: list[Column]) -> Column:
    """One number in which the bits of the ranks take turns, the highest first."""
    bits = [
        F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)).cast("long"), b * len(ranks) + i)
        for b in range(RANK_BITS)
        for i, rank in enumerate(ranks)
    ]
    return reduce(Column.bitwiseOR, bits)


def save_by_values(rows: DataFrame, path: str, values: list[str], tie: str, files: int) -> None:
    """Write rows so that filters on any of `values`, alone or together, meet few files.

    Rows without a value go with the smallest ones; `tie` orders rows of the same ranks.
    """
    names = [f"__rank_{i}" for i in range(len(values))]
    ranks = [_rank(F.col(f"`{v}`"), cuts).alias(name) for name, v, cuts in zip(names, values, _cuts(rows, values))]
    placed = rows.select("*", *ranks).withColumn("__place", _interleaved([F.col(n) for n in names]))
    save(placed, path, ["__place", tie], files, values, leave_out=["__place", *names])


def _layout(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/layout").first()["value"])


def _given(ranges: Ranges) -> dict[str, list[tuple[object, object]]]:
    """The columns that a filter restricts; a range open at both ends allows all, as no filter does."""
    listed = {column: list(held) for column, held in ranges.items()}
    return {column: held for column, held in listed.items() if (None, None) not in held}


def _meets(low: Column, high: Column, ranges: list[tuple[object, object]]) -> Column:
    """Whether values from low to high may lie in one of the ranges; not if there are no values."""
    tests = []
    for first, last in ranges:
        above = F.lit(True) if first is None else high >= F.lit(first)
        below = F.lit(True) if last is None else low <= F.lit(last)
        tests.append(above & below)
    return reduce(Column.__or__, tests, F.lit(False))


def file_bounds(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, low_i, high_i): the ends of the i-th bounded column in every file with rows."""
    return spark.read.parquet(f"{_layout(spark, path)['home']}/bounds")


def files_met(spark: SparkSession, path: str, ranges: Ranges) -> DataFrame:
    """(file, n_rows) of the files that can hold a row in the ranges."""
    bounded = _layout(spark, path)["bounded"]
    held = file_bounds(spark, path)
    for column, wanted in _given(ranges).items():
        if column in bounded:
            i = bounded.index(column)
            held = held.filter(_meets(F.col(f"low_{i}"), F.col(f"high_{i}"), wanted))
    return held.select("file", "n_rows")


def read(spark: SparkSession, path: str, ranges: Ranges | None = None) -> DataFrame:
    """The rows whose values lie in the given ranges; a null lies in none.

    The names of the files to read go through the driver, as those of any scan do.
    """
    layout = _layout(spark, path)
    schema = T.StructType.fromJson(json.loads(layout["schema"]))
    wanted = _given(ranges or {})
    if not wanted:
        return spark.read.schema(schema).parquet(f"{layout['home']}/data")
    files = [row.file for row in files_met(spark, path, wanted).collect()]
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*sorted(files))
    for column, held in wanted.items():
        value = F.col(f"`{column}`")
        if held and all(first == last for first, last in held):
            rows = rows.filter(value.isin([first for first, _ in held]))
        else:
            rows = rows.filter(value.isNotNull() & _meets(value, value, held))
    return rows
