"""Index sink and source: bucketed tables, so that searches need no shuffle of postings."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cadenza.operators import index as ix
from cadenza.operators.pivots import Pivots, group
from cadenza.operators.term_lists import term_lists

PARTS = ("documents", "postings", "terms", "fields", "keys", "lists", "vectors")
# A task that scores a batch holds a sum for every query and song of a bucket, so buckets stay small.
DOCUMENTS_PER_BUCKET = 4_000
# Buckets of the lists for each of the other tables: a request reads those of its words only.
LIST_BUCKETS = 4
# Fixed value: Spark's default limit on the buckets of a table.
MOST_BUCKETS = 100_000 // LIST_BUCKETS


def buckets_for(spark: SparkSession, n_documents: int) -> int:
    """Enough buckets to keep all cores busy, and more where buckets would grow too large."""
    by_size = -(-n_documents // DOCUMENTS_PER_BUCKET)
    return min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, by_size))


def _save_bucketed(df: DataFrame, table: str, path: str, buckets: int, by: str = "song_id") -> DataFrame:
    """One file per bucket, with the rows of a song (or key) next to each other and in order."""
    writer = df.repartition(buckets, by).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, by).sortBy(by)
    writer.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def _save(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _table(name: str, version: str, part: str) -> str:
    return f"{name}_{version}_{part}"


def save_counts(documents: DataFrame, name: str, path: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The term counts and field statistics of documents, stored under path for index.build_index.

    Texts are shuffled once, cut into words once and counted where they then are. Counts are bucketed by song
    and hold whole songs, so what is summed per song needs no shuffle. See buckets_for.
    """
    home = f"{path}/{uuid.uuid4().hex}"
    counts = ix.term_counts(documents.repartition(buckets, "song_id"))
    counts = _save_bucketed(counts, f"{name}_counts", f"{home}/counts", buckets)
    return counts, _save(ix.counted_stats(counts), f"{home}/fields")


def save_index(documents: DataFrame, name: str, path: str, buckets: int) -> ix.Index:
    """Build the index anew under path. See buckets_for.

    Every build is a folder of its own. The layout that names the current one is written last, so a
    reader has all parts of one build, whatever becomes of a build under way; older folders stay
    until they are cleared away. Beyond MOST_BUCKETS * DOCUMENTS_PER_BUCKET documents buckets grow.
    """
    spark = documents.sparkSession
    version = uuid.uuid4().hex
    home = f"{path}/{version}"
    docs = _save_bucketed(documents, _table(name, version, "documents"), f"{home}/documents", buckets)
    fields = _save(ix.field_stats(docs), f"{home}/fields")
    posts = ix.postings(ix.term_counts(docs), fields)
    posts = _save_bucketed(posts, _table(name, version, "postings"), f"{home}/postings", buckets)
    # As many files as buckets: finding near spellings costs far more time than bytes.
    terms = _save(ix.list_stats(posts).repartition(buckets, "term"), f"{home}/terms")
    keys = _save(ix.word_keys(terms.repartition(buckets, "term")), f"{home}/keys")
    blocks = term_lists(posts, terms, LIST_BUCKETS * buckets)
    lists = _save_bucketed(blocks, _table(name, version, "lists"), f"{home}/lists", LIST_BUCKETS * buckets, "block")
    near = group(docs)
    vectors = _save_bucketed(near.vectors, _table(name, version, "vectors"), f"{home}/vectors", LIST_BUCKETS * buckets, "block")
    groups = Pivots(vectors, *[_save(df, f"{home}/{part}") for df, part in ((near.blocks, "blocks"), (near.pivots, "pivots"))])
    schemas = {p: d.schema.jsonValue() for p, d in zip(PARTS, (docs, posts, terms, fields, keys, lists, vectors))}
    layout = json.dumps({"version": version, "buckets": buckets, "schemas": schemas})
    one = spark.createDataFrame([(layout,)], "layout string").coalesce(1)
    one.write.mode("overwrite").text(f"{path}/layout")
    return ix.Index(docs, posts, terms, fields, keys, lists, groups)


def open_index(spark: SparkSession, name: str, path: str) -> ix.Index:
    """The last index that save_index finished under path, also from another session.

    Tables are named after the build, so a name never leads to the parts of another index.
    """
    layout = json.loads(spark.read.text(f"{path}/layout").first()["value"])
    home = f"{path}/{layout['version']}"
    if "keys" not in T.StructType.fromJson(layout["schemas"]["keys"]).fieldNames():
        raise ValueError(f"the index under {path} has its keys in an older form: build it anew")

    def bucketed(part: str, by: str = "song_id", more: int = 1) -> DataFrame:
        table = _table(name, layout["version"], part)
        if not spark.catalog.tableExists(table):
            schema = T.StructType.fromJson(layout["schemas"][part])
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet "
                f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {more * layout['buckets']} BUCKETS "
                f"LOCATION '{home}/{part}'"
            )
        return spark.table(table)

    parts = [spark.read.parquet(f"{home}/{part}") for part in ("terms", "fields", "keys")]
    held = bucketed("documents"), bucketed("postings"), *parts
    groups = Pivots(bucketed("vectors", "block", LIST_BUCKETS), *[spark.read.parquet(f"{home}/{part}") for part in ("blocks", "pivots")])
    return ix.Index(*held, bucketed("lists", "block", LIST_BUCKETS), groups)
