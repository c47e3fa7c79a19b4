"""Tables kept as buckets of rows, of which a change rewrites only those that it touches.

A row lies in the bucket of its key's hash. Every version has a manifest that names, for each bucket,
the version that wrote it last; a bucket that no change has touched stays where it is. The manifest is
written last, so a reader finds whole versions only, and a change that is repeated after a failure
overwrites nothing but its own output.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"
FIRST = -1


@dataclass(frozen=True)
class Manifest:
    """Of one version: keys and number of buckets, the schema, which version holds each bucket that has
    rows, and a few numbers kept with the table."""

    version: int
    keys: list[str]
    buckets: int
    schema: str
    holders: dict[int, int]
    state: dict[str, int]

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> Manifest:
        values = json.loads(text)
        return Manifest(**values | {"holders": {int(b): v for b, v in values["holders"].items()}})


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path
    return made, made(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, pattern: str) -> list[str]:
    made, files = _files(spark, pattern)
    return [str(status.getPath().getName()) for status in files.globStatus(made(pattern)) or []]


def _data(path: str, version: int) -> str:
    return f"{path}/data/version={version}"


def _manifest(path: str, version: int) -> str:
    return f"{path}/manifest/version={version}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are complete, in order."""
    made, files = _files(spark, path)
    done = files.globStatus(made(f"{path}/manifest/version=*/_SUCCESS")) or []
    return sorted(int(str(s.getPath().getParent().getName()).partition("=")[2]) for s in done)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """That of a version, or of the last one."""
    if version is None:
        version = versions(spark, path)[-1]
    return Manifest.from_json(spark.read.text(_manifest(path, version)).first()["value"])


def _write_rows(rows: DataFrame, path: str, version: int, keys: list[str], buckets: int) -> dict[int, int]:
    """Write rows by bucket; the buckets that have some. A very large bucket is written by several tasks."""
    target = _data(path, version)
    marked = rows.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", BUCKET)
    marked.write.mode("overwrite").partitionBy(BUCKET).parquet(target)
    held = _names(rows.sparkSession, f"{target}/{BUCKET}=*")
    return {int(name.partition("=")[2]): version for name in held}


def _write_manifest(spark: SparkSession, path: str, made: Manifest) -> None:
    one = spark.createDataFrame([(made.to_json(),)], "value string").coalesce(1)
    one.write.mode("overwrite").text(_manifest(path, made.version))


def create(rows: DataFrame, path: str, keys: list[str], buckets: int, state: dict[str, int] | None = None) -> Manifest:
    """Write a table as its first version."""
    holders = _write_rows(rows, path, FIRST, keys, buckets)
    made = Manifest(FIRST, keys, buckets, rows.schema.json(), holders, state or {})
    _write_manifest(rows.sparkSession, path, made)
    return made


def read(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version (the last one), of all buckets or of some."""
    held = manifest(spark, path, version)
    schema = T.StructType.fromJson(json.loads(held.schema))
    wanted = held.holders if only is None else {b: held.holders[b] for b in only if b in held.holders}
    paths = [f"{_data(path, version)}/{BUCKET}={bucket}" for bucket, version in sorted(wanted.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched(changes: DataFrame, held: Manifest) -> list[int]:
    """The buckets that changes with the table's keys fall into, at most as many as there are."""
    found = changes.select(bucket_of(held.keys, held.buckets).alias("b")).distinct().collect()
    return sorted(r.b for r in found)


def rewrite(
    spark: SparkSession, path: str, before: Manifest, version: int, buckets: list[int], rows: DataFrame, state: dict[str, int] | None = None
) -> Manifest:
    """A new version in which the given buckets hold `rows` and all others what they held."""
    written = _write_rows(rows, path, version, before.keys, before.buckets) if buckets else {}
    holders = {b: v for b, v in before.holders.items() if b not in set(buckets)} | written
    made = replace(before, version=version, holders=holders, state=before.state | (state or {}))
    _write_manifest(spark, path, made)
    return made


def change(
    spark: SparkSession, path: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]
) -> Manifest:
    """The next version: apply(old rows, changes), for the buckets of the changes alone.

    apply must leave rows of other keys as they are.
    """
    before = manifest(spark, path)
    buckets = touched(changes, before)
    old = read(spark, path, before.version, buckets)
    return rewrite(spark, path, before, before.version + 1, buckets, apply(old, changes))


def written_bytes(spark: SparkSession, path: str, version: int) -> int:
    """Bytes of the rows that a version wrote."""
    made, files = _files(spark, path)
    target = made(_data(path, version))
    return files.getContentSummary(target).getLength() if files.exists(target) else 0


def drop(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the last `keep` versions, with the files that no later one still names."""
    done = versions(spark, path)
    old, kept = done[: -max(1, keep)], done[-max(1, keep) :]
    named = {(b, v) for number in kept for b, v in manifest(spark, path, number).holders.items()}
    made, files = _files(spark, path)
    for number in old:
        files.delete(made(_manifest(path, number)), True)
    # Also files of versions dropped before, which were still named then.
    for folder in _names(spark, f"{path}/data/version=*"):
        number = int(folder.partition("=")[2])
        for name in _names(spark, f"{_data(path, number)}/{BUCKET}=*") if kept and number < kept[0] else ():
            if (int(name.partition("=")[2]), number) not in named:
                files.delete(made(f"{_data(path, number)}/{name}"), True)
    return old
