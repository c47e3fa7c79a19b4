"""Exact nearest neighbours that visit only the vectors which can be among them.

Vectors are grouped around pivots, and groups are cut into blocks; of each block the smallest and
largest angle to its pivot are kept. By the triangle inequality on the sphere, a query at angle t from
the pivot is at least t - outer or inner - t, and at most t + outer, from every vector of the block.
So a query first knows, without reading a vector, how near its k nearest are at most, then visits
the nearest blocks, and with what it has found there leaves out all blocks that are too far away.
Queries meet blocks by a join, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import knn
from cadenza.session import cut, send_with_tasks

send_with_tasks(__name__)

MOST_PIVOTS = 1024
PIVOT_BYTES = 8 << 20
BLOCK = 4096
# Parts of one group at most, as its blocks are numbered.
MOST_PARTS = 1 << 20
# The bounds of all blocks go to the tasks up to so many; beyond, every vector is visited.
MOST_BLOCKS = 2_000_000
NAMED_BLOCKS = 20_000
QUERIES_AT_ONCE = 4096
# Below so many pairs of a query and a vector, all are visited: that takes a single pass.
LEAST_PRODUCTS = 2_000_000_000
# Vectors visited first, as a multiple of the neighbours asked for.
FIRST = 4
# Scores are rounded to six decimals, angles are computed from rounded products.
MARGIN = 2e-6
SLACK = 1e-7


@dataclass(frozen=True)
class Pivots:
    """vectors (song_id, embedding, block); blocks (block, pivot, n, inner, outer); pivots (pivot, vec)."""

    vectors: DataFrame
    blocks: DataFrame
    pivots: DataFrame


def choose_pivots(documents: DataFrame, most: int = MOST_PIVOTS) -> np.ndarray:
    """Unit vectors of some documents, those of the smallest hashes: about the root of their number,
    bounded in number and bytes."""
    given = documents.filter("embedding IS NOT NULL")
    size = given.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    if not size["n"]:
        return np.zeros((0, 0))
    wanted = max(1, min(most, int(size["n"] ** 0.5), PIVOT_BYTES // (8 * size["dims"])))
    rows = given.select("embedding").orderBy(F.xxhash64("song_id"), "song_id").limit(wanted).collect()
    return knn._unit(np.array([r.embedding for r in rows], dtype=np.float64))


def group(documents: DataFrame, most: int = MOST_PIVOTS) -> Pivots:
    """Put every vector into a block of its nearest pivot."""
    spark = documents.sparkSession
    pivots = choose_pivots(documents, most)
    shared = spark.sparkContext.broadcast(pivots)
    fields = "song_id string, embedding array<float>, pivot long, angle double"

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = knn._unit_column(batch.column("embedding")) @ shared.value.T
            nearest = cosines.argmax(axis=1)
            angles = np.arccos(np.clip(cosines[np.arange(len(nearest)), nearest], -1, 1))
            columns = [batch.column("song_id"), batch.column("embedding"), pa.array(nearest.astype(np.int64)), pa.array(angles)]
            yield pa.RecordBatch.from_arrays(columns, names=["song_id", "embedding", "pivot", "angle"])

    placed = cut(documents.select("song_id", "embedding").filter("embedding IS NOT NULL").mapInArrow(place, fields))
    sizes = placed.groupBy("pivot").agg(F.least(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(MOST_PARTS)).alias("parts"))
    # One row per pivot.
    dealt = placed.join(F.broadcast(sizes), "pivot").withColumn(
        "block", F.col("pivot") * MOST_PARTS + F.pmod(F.xxhash64("song_id"), F.col("parts"))
    )
    blocks = dealt.groupBy("block", "pivot").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("inner"), F.max("angle").alias("outer"))
    listed = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pivots)], "pivot long, vec array<double>")
    return Pivots(dealt.select("song_id", "embedding", "block"), blocks, listed)


def bounds(queries: np.ndarray, pivots: np.ndarray, blocks: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest angle between each query and the vectors of each block."""
    angles = np.arccos(np.clip(queries @ pivots.T, -1, 1))[:, blocks["pivot"]]
    least = np.maximum(np.maximum(angles - blocks["outer"], blocks["inner"] - angles), 0.0)
    return np.maximum(least - SLACK, 0.0), np.minimum(angles + blocks["outer"], np.pi) + SLACK


def _visits(asked: DataFrame, held: Pivots, k: int, id_type: str) -> DataFrame:
    """(query_id, vec, block, best, first): the blocks that each query may have to visit, with the best
    score that one of their vectors can have."""
    spark = asked.sparkSession
    pivots = np.array([r.vec for r in held.pivots.orderBy("pivot").collect()], dtype=np.float64)
    rows = held.blocks.toPandas()
    blocks = {name: rows[name].to_numpy() for name in ("block", "pivot", "n", "inner", "outer")}
    shared = spark.sparkContext.broadcast((pivots, blocks))

    def run(batches):
        pivots, blocks = shared.value
        step = max(1, 4_000_000 // max(1, len(blocks["block"])))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            least, largest = bounds(knn._unit_column(batch.column("vec")), pivots, blocks)
            for row in range(batch.num_rows):
                # At least k vectors are no farther than this.
                order = np.argsort(largest[row], kind="stable")
                enough = np.searchsorted(np.cumsum(blocks["n"][order]), k)
                limit = largest[row][order[min(enough, len(order) - 1)]] if enough < len(order) else np.pi + 1
                near = np.flatnonzero(least[row] <= limit)
                near = near[np.argsort(least[row][near], kind="stable")]
                before = np.cumsum(blocks["n"][near]) - blocks["n"][near]
                n = len(near)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array([row] * n)), batch.column("vec").take(pa.array([row] * n)),
                     pa.array(blocks["block"][near]), pa.array((1 + np.cos(least[row][near])) / 2), pa.array(before < FIRST * k)],
                    names=["query_id", "vec", "block", "best", "first"],
                )

    return asked.select("query_id", "vec").mapInArrow(run, f"query_id {id_type}, vec array<float>, block long, best double, first boolean")


def _visit(held: Pivots, visits: DataFrame, k: int, schema: str, parts: int) -> DataFrame:
    """The k best of every visited block for each query."""
    wanted = cut(visits.select("block").distinct())
    named = wanted.limit(NAMED_BLOCKS + 1).collect()
    # Few blocks are named, so that only their buckets are read; no more rows than blocks otherwise.
    vectors = (
        held.vectors.filter(F.col("block").isin([r.block for r in named]))
        if len(named) <= NAMED_BLOCKS
        else held.vectors.join(F.broadcast(wanted), "block", "left_semi")
    )
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    vectors = vectors.withColumn("part", copies)
    asked = visits.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        kind = asked.schema.field("query_id").type
        if not docs.num_rows or not asked.num_rows:
            empty = [pa.array([], kind), pa.array([], pa.string()), pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, names=["query_id", "song_id", "score"])
        names = docs.column("song_id").to_numpy().astype(object)
        order = np.argsort(names)
        unit = knn._unit_column(docs.column("embedding").combine_chunks())[order]
        ids = asked.column("query_id").combine_chunks()
        scores = knn._rounded_scores(knn._unit_column(asked.column("vec").combine_chunks()), unit)
        held, best = knn._merged(
            np.empty((len(ids), 0), dtype=np.int64), np.empty((len(ids), 0)), np.arange(len(names)), scores, k
        )
        columns = [ids.take(pa.array(np.repeat(np.arange(len(ids)), held.shape[1]))), pa.array(names[order][held.ravel()], pa.string()), pa.array(best.ravel())]
        return pa.Table.from_arrays(columns, names=["query_id", "song_id", "score"])

    by = ["block", "part"]
    return vectors.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, schema)


@dataclass(frozen=True)
class Visited:
    """What a search visited: pairs of a query and a vector, of how many."""

    pairs: int
    of: int


def nearest_counted(held: Pivots, queries: DataFrame, k: int = knn.NEIGHBOURS) -> tuple[DataFrame, Visited] | None:
    """(query_id, song_id, score) as knn.nearest gives it, and how much was visited; None if there are
    too many blocks to send their bounds to the tasks."""
    spark = queries.sparkSession
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, song_id string, score double"
    asked = cut(queries.select("query_id", "vec").filter(F.exists("vec", lambda x: x != 0)))
    n_queries = asked.count()
    size = held.blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors")).first()
    if size["n"] > MOST_BLOCKS:
        return None
    if not n_queries or not size["vectors"]:
        return spark.createDataFrame([], schema), Visited(0, 0)
    parts = max(1, -(-n_queries // QUERIES_AT_ONCE))
    visits = cut(_visits(asked, held, k, id_type))
    first = cut(knn._best_rows(_visit(held, visits.filter("first"), k, schema, parts), k))
    last = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least"))
    # One number per query; a query with fewer than k neighbours so far goes on.
    rest = visits.filter(~F.col("first")).join(last, "query_id", "left")
    open_ = F.coalesce(F.col("found") < k, F.lit(True)) | (F.col("best") + MARGIN >= F.col("least"))
    rest = cut(rest.filter(open_).select("query_id", "vec", "block", "best", "first"))
    found = first
    if rest.take(1):
        found = knn._best_rows(first.unionByName(_visit(held, rest, k, schema, parts)), k)
    pairs = visits.filter("first").select("block").unionAll(rest.select("block")).join(held.blocks.select("block", "n"), "block")
    visited = pairs.agg(F.sum("n").alias("n")).first()["n"] or 0
    return found, Visited(visited, n_queries * size["vectors"])


def worth_it(held: Pivots | None, queries: int, products: int | None = None) -> bool:
    """Whether so many queries save more by bounds than visiting every vector once costs."""
    if held is None or not queries:
        return False
    vectors = held.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return vectors * queries > (LEAST_PRODUCTS if products is None else products)


def nearest(held: Pivots, queries: DataFrame, k: int = knn.NEIGHBOURS) -> DataFrame | None:
    found = nearest_counted(held, queries, k)
    return None if found is None else found[0]
