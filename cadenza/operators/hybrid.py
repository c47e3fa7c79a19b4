"""Hybrid search: vector, keyword and prompt clauses added up, filtered, best hits per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators import filters as fl
from cadenza.operators import knn, lexical, pivots
from cadenza.operators.index import Index
from cadenza.operators.skew import join_in_parts
from cadenza.operators.term_lists import best_songs
from cadenza.session import cut

# Clause names in the order they are reported.
CLAUSES = {"vector": "vector_search", "keyword": "keyword_search", "prompt": "prompt_search"}


REQUEST = (
    "query_id long, prompt string, keywords array<string>, vec array<float>, size int, energy_min double, "
    "energy_max double, artist string, popularity_min int, popularity_max int"
)


def request(
    spark: SparkSession,
    prompt: str,
    vec: list[float] | None = None,
    keywords: list[str] | None = None,
    size: int = lexical.PAGE_SIZE,
    energy_min: float | None = None,
    energy_max: float | None = None,
    artist: str | None = None,
    popularity_min: int | None = None,
    popularity_max: int | None = None,
) -> DataFrame:
    """A single request as a table of one query."""
    row = (0, prompt, keywords, vec, size, energy_min, energy_max, artist, popularity_min, popularity_max)
    return spark.createDataFrame([row], REQUEST)


def clause_weights(
    index: Index, queries: DataFrame, batch: lexical.BatchSize, expansions: int | None = lexical.MAX_EXPANSIONS
) -> DataFrame:
    """(query_id, field, term, keyword, prompt): one row per word that scores for a query."""
    zero = F.lit(0.0)
    keyword = lexical.keyword_weights(index, lexical.keyword_words(queries), batch)
    prompt = lexical.prompt_weights(index, lexical.prompt_words(queries), batch, expansions)
    word = ["query_id", "field", "term"]
    both = keyword.select(*word, F.col("weight").alias("keyword"), zero.alias("prompt")).unionByName(
        prompt.select(*word, zero.alias("keyword"), F.col("weight").alias("prompt"))
    )
    return both.groupBy(*word).agg(F.sum("keyword").alias("keyword"), F.sum("prompt").alias("prompt"))


def _size(queries: DataFrame, size: int) -> Column:
    return F.coalesce(F.col("size"), F.lit(size)) if "size" in queries.columns else F.lit(size)


def _best(rows: DataFrame, batch: lexical.BatchSize) -> DataFrame:
    """The page of each query. The fixed limit lets every task cut its rows before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "song_id")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") <= batch.largest_page) & (F.col("rank") <= F.col("__size")))


def search(
    index: Index,
    queries: DataFrame,
    size: int = lexical.PAGE_SIZE,
    use_filters: bool = True,
    require_match: bool = False,
    neighbours: int = knn.NEIGHBOURS,
    expansions: int | None = lexical.MAX_EXPANSIONS,
) -> DataFrame:
    """(query_id, rank, song_id, score, matched_queries) for a batch of queries.

    queries hold query_id, prompt, vec and optionally keywords, size and the filter columns.
    The nearest vectors are found among all documents and filtered afterwards. A query with
    filters also returns passing documents that match no clause, with score 0, unless
    require_match is set. neighbours is the number of vector hits per query, expansions that of
    indexed words a search word stands for per field (None: all).
    """
    use_filters = use_filters and bool(set(fl.FILTER_COLUMNS) & set(queries.columns))
    own_sizes = "size" in queries.columns
    if "keywords" not in queries.columns:
        queries = queries.withColumn("keywords", F.lit(None).cast("array<string>"))
    queries = fl.with_filter_columns(queries).withColumn("__size", _size(queries, size))
    batch = lexical.batch_size(queries, size)
    few_vectors = batch.queries * neighbours <= lexical.SMALL_ROWS
    limits = fl.query_limits(queries, "__size")
    values = fl.document_values(index.documents)

    # Read twice below, and at most `neighbours` rows per query.
    vectors = pivots.nearest(index.groups, queries, neighbours) if pivots.worth_it(index.groups, batch.queries) else None
    if vectors is None:
        vectors = knn.nearest(index.documents, queries, neighbours)
    vectors = cut(vectors.select("query_id", "song_id", F.col("score").alias("vector")))
    weights = cut(clause_weights(index, queries, batch, expansions))
    # Without filters, few words need only what can reach the page, and what the vectors have found.
    lexical_scores = None
    if not use_filters and batch.small_words:
        lexical_scores = best_songs(index, weights, batch.largest_page, vectors)
    if lexical_scores is None:
        lexical_scores = lexical.score_postings(index, weights)

    def limited(rows: DataFrame) -> DataFrame:
        """Add page size and filters. A query may match most documents, so it is split."""
        if not use_filters and not own_sizes:
            return rows.withColumn("__size", F.lit(size))
        if batch.few_queries:
            return rows.join(F.broadcast(limits), "query_id")
        return join_in_parts(rows, limits, ["query_id"], ["song_id"])

    def finish(rows: DataFrame) -> DataFrame:
        """Apply filters, add up the clauses and keep the best rows of each query."""
        rows = limited(rows)
        if use_filters:
            rows = rows.filter(fl.passes())
        vector = F.coalesce("vector", F.lit(0.0))
        score = F.round(vector + F.col("keyword") + F.col("prompt"), 6)
        met = {"vector": F.col("vector").isNotNull(), "keyword": F.col("keyword") > 0, "prompt": F.col("prompt") > 0}
        names = F.array(*[F.when(met[clause], F.lit(name)) for clause, name in CLAUSES.items()])
        named = F.filter(names, lambda n: n.isNotNull()).alias("matched_queries")
        return _best(rows.select("query_id", "__size", "song_id", score.alias("score"), named), batch)

    by_words = lexical_scores.join(lexical.small(vectors, few_vectors), ["query_id", "song_id"], "left")
    by_vector = vectors.withColumn("keyword", F.lit(0.0)).withColumn("prompt", F.lit(0.0))
    if use_filters:
        by_words = by_words.join(values, "song_id")
        by_vector = values.join(lexical.small(by_vector, few_vectors), "song_id")
    # A vector hit with matching words appears in both parts; its full score is the larger one.
    # If the full row missed the best of its part, so does the row with the vector alone.
    full = finish(by_words).drop("rank").unionByName(finish(by_vector).drop("rank"))
    once = Window.partitionBy("query_id", "song_id").orderBy(F.desc("score"), F.desc(F.size("matched_queries")))
    hits = _best(full.withColumn("__copy", F.row_number().over(once)).filter("__copy = 1").drop("__copy"), batch)

    if use_filters and not require_match:
        hits = cut(hits)
        hits = _fill_with_passing(index, queries, hits, batch)
    return hits.select("query_id", "rank", "song_id", "score", "matched_queries")


def _fill_with_passing(index: Index, queries: DataFrame, hits: DataFrame, batch: lexical.BatchSize) -> DataFrame:
    """Top up queries with filters and too few hits by passing documents of score 0."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("__found"))
    short = queries.join(found, "query_id", "left").filter(F.coalesce("__found", F.lit(0)) < F.col("__size"))
    more = fl.first_passing(index.documents, short, "__size", batch.largest_page, batch.few_queries)
    more = more.join(hits.select("query_id", "song_id"), ["query_id", "song_id"], "left_anti")
    more = more.join(queries.select("query_id", "__size"), "query_id")
    zero = more.select(
        "query_id",
        "__size",
        "song_id",
        F.lit(0.0).alias("score"),
        F.array().cast("array<string>").alias("matched_queries"),
    )
    return _best(hits.drop("rank").unionByName(zero), batch)
