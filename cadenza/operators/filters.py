"""Range and text filters of a search, for one request or for a batch of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import words
from cadenza.operators.skew import join_many_to_one

FILTER_COLUMNS = ("energy_min", "energy_max", "artist", "popularity_min", "popularity_max")
# Coarse value bins for the filter join; values outside fall into the first or last bin.
BINS = 32
# Filters are sent to every task only up to so many bytes, with so many per row besides texts.
SMALL_BYTES = 64 << 20
ROW_BYTES = 64
BIN_WIDTH = {"popularity": 100 / BINS, "energy": 1 / BINS}


def range_filter(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive bounds, each optional; 0 is a bound. A null value fails any given bound."""
    if low is not None:
        df = df.filter(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.filter(F.col(column) <= F.lit(high))
    return df


def match_filter(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Rows sharing at least one word with text; an absent or empty text filters nothing."""
    if not text:
        return df
    return df.filter(F.arrays_overlap(words(F.col(column)), words(F.lit(text))))


def _in_range(value: Column, low: Column, high: Column) -> Column:
    above = low.isNull() | (value >= low)
    below = high.isNull() | (value <= high)
    return F.coalesce(above & below, F.lit(False))


def has_filter() -> Column:
    """Whether a query has any filter; an empty artist is none."""
    numbers = [F.col(name).isNotNull() for name in FILTER_COLUMNS if name != "artist"]
    artist = F.coalesce(F.col("artist") != "", F.lit(False))
    return reduce(Column.__or__, numbers, artist)


def document_values(documents: DataFrame) -> DataFrame:
    """What the filters look at, with the artist name cut into words once per document."""
    return documents.select("song_id", "energy", "popularity", words(F.col("name_artists")).alias("name_words"))


def query_limits(queries: DataFrame, *keep: str) -> DataFrame:
    """The filters of each query, with the artist text cut into words."""
    return queries.select("query_id", *FILTER_COLUMNS, words(F.col("artist")).alias("artist_words"), *keep)


def passes() -> Column:
    """Whether a row of query_limits joined with document_values passes."""
    artist = F.col("artist")
    return (
        _in_range(F.col("energy"), F.col("energy_min"), F.col("energy_max"))
        & _in_range(F.col("popularity"), F.col("popularity_min"), F.col("popularity_max"))
        & (artist.isNull() | (artist == "") | F.arrays_overlap("name_words", "artist_words"))
    )


def with_filter_columns(queries: DataFrame) -> DataFrame:
    """Add the filter columns a query table lacks, as nulls."""
    for name in FILTER_COLUMNS:
        if name not in queries.columns:
            kind = "string" if name == "artist" else "double"
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    return queries


def _bin(value: Column, name: str) -> Column:
    raw = F.floor(value / BIN_WIDTH[name])
    clipped = F.least(F.greatest(raw, F.lit(0)), F.lit(BINS - 1)).cast("int")
    return F.when(value.isNotNull(), clipped)


def _bins_between(low: Column, high: Column, name: str) -> Column:
    first = F.coalesce(_bin(low, name), F.lit(0))
    last = F.coalesce(_bin(high, name), F.lit(BINS - 1))
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda b: F.concat_ws(":", F.lit(name), b))


def _artist_keys(names: str) -> Column:
    return F.transform(F.array_distinct(names), lambda w: F.concat_ws(":", F.lit("artist"), w))


def _bin_counts(documents: DataFrame) -> dict[str, list[int]]:
    """How many documents there are in every bin of a value; at most BINS rows for each come back."""
    found = {}
    for name in BIN_WIDTH:
        rows = documents.groupBy(_bin(F.col(name), name).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        held = {r["bin"]: r["n"] for r in rows}
        found[name] = [held.get(b, 0) for b in range(BINS)]
    return found


def _documents_between(name: str, counts: list[int]) -> Column:
    """How many documents the bins of a query's range hold."""
    first = F.coalesce(_bin(F.col(f"{name}_min"), name), F.lit(0))
    last = F.coalesce(_bin(F.col(f"{name}_max"), name), F.lit(BINS - 1))
    held = F.slice(F.array(*map(F.lit, counts)), first + 1, F.greatest(last - first + 1, F.lit(0)))
    return F.aggregate(held, F.lit(0).cast("long"), lambda total, n: total + n)


def _query_keys(counts: dict[str, list[int]]) -> Column:
    """One access path per query: artist words, else the bins that hold the fewest documents."""
    artist = F.col("artist")
    given = {name: F.col(f"{name}_min").isNotNull() | F.col(f"{name}_max").isNotNull() for name in BIN_WIDTH}
    cost = {name: F.when(given[name], _documents_between(name, counts[name])) for name in BIN_WIDTH}
    fewer = cost["energy"].isNull() | (cost["popularity"] <= cost["energy"])
    return (
        F.when(artist.isNotNull() & (artist != ""), _artist_keys("artist_words"))
        .when(given["popularity"] & fewer, _bins_between(F.col("popularity_min"), F.col("popularity_max"), "popularity"))
        .otherwise(_bins_between(F.col("energy_min"), F.col("energy_max"), "energy"))
    )


def _document_keys() -> Column:
    def one(name: str) -> Column:
        return F.concat_ws(":", F.lit(name), _bin(F.col(name), name))

    bins = F.array(
        F.when(F.col("popularity").isNotNull(), one("popularity")),
        F.when(F.col("energy").isNotNull(), one("energy")),
    )
    return F.concat(F.filter(bins, lambda k: k.isNotNull()), _artist_keys("name_words"))


def passing_documents(documents: DataFrame, queries: DataFrame, small_queries: bool, *keep: str) -> DataFrame:
    """(query_id, song_id, keep...) of every document that passes a query's filters.

    Documents and queries meet on a shared word or value bin, never all with all. A document that
    shares several artist words with a query is met at each and counted at the smallest.
    """
    keys = _query_keys(_bin_counts(documents))
    limits = query_limits(queries.filter(has_filter()), *keep)
    # A key stands next to all that its query asks for, the artist text whole and in words.
    row = 3 * F.coalesce(F.octet_length("artist"), F.lit(0)) + 2 * ROW_BYTES
    sent = F.sum(F.size(keys) * row)
    small_queries = small_queries and (limits.agg(sent).first()[0] or 0) <= SMALL_BYTES
    wanted = limits.withColumn("__key", F.explode(keys))
    held = document_values(documents).withColumn("__key", F.explode(_document_keys()))
    if small_queries:
        met = held.join(F.broadcast(wanted), "__key")
    else:
        met = join_many_to_one(held, wanted, ["__key"], ["song_id"], "inner")
    smallest = F.array_min(F.array_intersect("name_words", "artist_words"))
    counted = ~F.col("__key").startswith("artist:") | (F.col("__key") == F.concat_ws(":", F.lit("artist"), smallest))
    met = met.filter(passes() & counted)
    return met.select("query_id", "song_id", *keep)


def first_passing(
    documents: DataFrame, queries: DataFrame, size: str, largest: int, small_queries: bool
) -> DataFrame:
    """For each query with a filter, as many passing documents as its `size` column says, smallest
    ids first.

    No size is above `largest`: each task keeps only so many documents per query before anything
    is shuffled.
    """
    met = passing_documents(documents, queries, small_queries, size)
    by_id = Window.partitionBy("query_id").orderBy("song_id")
    ranked = met.withColumn("__rank", F.row_number().over(by_id))
    kept = ranked.filter((F.col("__rank") <= largest) & (F.col("__rank") <= F.col(size)))
    return kept.select("query_id", "song_id")
