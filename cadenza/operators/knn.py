"""Exact nearest neighbours by cosine for a batch of query vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cadenza.session import cut, send_with_tasks

send_with_tasks(__name__)

NEIGHBOURS = 100
# Query vectors sent to every task at once, in bytes.
SMALL_QUERY_BYTES = 64 * 1024 * 1024
# Scores held at once by a task.
SCORES_AT_ONCE = 8_000_000
MERGE_PARTS = 32
QUERIES_PER_BLOCK = 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _unit_column(vectors: pa.ListArray) -> np.ndarray:
    """The vectors of an Arrow column as rows of one matrix, without a Python list per row."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(vectors), -1))


def _rounded_scores(queries: np.ndarray, documents: np.ndarray) -> np.ndarray:
    return np.round((1.0 + queries @ documents.T) / 2.0, 6)


def _merged(ids: np.ndarray, scores: np.ndarray, more_ids: np.ndarray, more: np.ndarray, k: int):
    """The k best of every row: held ids and scores, and those of a block of documents.

    The block's ids are one list for all rows.
    """
    if more.shape[1] > k:
        # All at the score of the k-th best can still be needed, for their smaller ids.
        floor = np.partition(more, more.shape[1] - k, axis=1)[:, more.shape[1] - k][:, None]
        width = int((more >= floor).sum(axis=1).max())
        top = np.argpartition(-more, min(width, more.shape[1]) - 1, axis=1)[:, :width]
        more, own = np.take_along_axis(more, top, axis=1), more_ids[top]
    else:
        own = np.broadcast_to(more_ids, more.shape)
    ids, scores = np.concatenate([ids, own], axis=1), np.concatenate([scores, more], axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _best_of_stream(query_ids: list, unit: np.ndarray, k: int, out: pa.Schema):
    """Keep k neighbours per query over all batches of a task, then give them out once.

    Ids are compared as places in the order of the ids met so far, so a whole block of scores is
    merged at once.
    """
    step = max(1, SCORES_AT_ONCE // max(1, len(query_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.empty(0, dtype=object)
        ids, scores = np.empty((len(query_ids), 0), dtype=np.int64), np.empty((len(query_ids), 0))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            new = batch.column("song_id").to_numpy(zero_copy_only=False).astype(object)
            # Names of held neighbours and of the block, in order; both get places in the new order.
            held = np.unique(ids)
            order, places = np.unique(np.concatenate([names[held], new]), return_inverse=True)
            moved = np.zeros(len(names), dtype=np.int64)
            moved[held] = places[: len(held)]
            names, ids = order, moved[ids]
            more = _rounded_scores(unit, _unit_column(batch.column("embedding")))
            ids, scores = _merged(ids, scores, places[len(held) :], more, k)
        for at in range(0, len(query_ids), QUERIES_PER_BLOCK):
            part = slice(at, at + QUERIES_PER_BLOCK)
            asked = np.repeat(np.array(query_ids[part], dtype=object), ids.shape[1])
            columns = [pa.array(c, type=t) for c, t in zip((asked, names[ids[part].ravel()], scores[part].ravel()), out.types)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return run


def _in_passes(documents: DataFrame, queries: DataFrame, schema: str, k: int, passes: int) -> DataFrame:
    """One visit of the documents, which stay where they are, for each part of the queries."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    found = [_one_pass(documents, queries.filter(part == number), schema, k) for number in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _one_pass(documents: DataFrame, queries: DataFrame, schema: str, k: int) -> DataFrame:
    batch = queries.toPandas()
    if batch.empty:
        return documents.sparkSession.createDataFrame([], schema)
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    run = _best_of_stream(batch["query_id"].tolist(), _unit_rows(batch["vec"]), k, out)
    # Every task of a large table gives k rows per query: first merge them in parts.
    found = documents.mapInArrow(run, schema)
    merged = _best_rows(found.withColumn("__part", F.pmod(F.xxhash64("song_id"), F.lit(MERGE_PARTS))), k, "__part")
    merged = _best_rows(merged.drop("__part"), k)
    # Written, so that the vectors of one part need not be held while the next are sent.
    return cut(merged)


def _best_rows(found: DataFrame, k: int, *within: str) -> DataFrame:
    order = Window.partitionBy("query_id", *within).orderBy(F.desc("score"), "song_id")
    return found.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k).drop("__rank")


def nearest(
    documents: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, small_query_bytes: int = SMALL_QUERY_BYTES
) -> DataFrame:
    """(query_id, song_id, score): the k documents of highest cosine for every query vector.

    documents need song_id and embedding, queries query_id and vec; a query without a vector or
    with a zero vector has no neighbours. Scores are (1 + cos) / 2
    on six decimals, ties go to the smaller id. Queries visit every document where it lies, so
    documents are never shuffled; vectors of more than small_query_bytes come in several passes.
    """
    docs = documents.select("song_id", "embedding").filter("embedding IS NOT NULL")
    asked = queries.select("query_id", "vec").filter(F.exists("vec", lambda x: x != 0))
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, song_id string, score double"
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    bytes_ = size["n"] * (size["dims"] or 0) * 8
    if not bytes_:
        return docs.sparkSession.createDataFrame([], schema)
    return _in_passes(docs, asked, schema, k, max(1, -(-bytes_ // max(1, small_query_bytes))))
