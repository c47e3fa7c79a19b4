"""Add release date, links and energy to search hits and shape them as results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import DEFAULT_ARTIST, DEFAULT_TITLE, or_else
from cadenza.operators.skew import HOT_ROWS, join_many_to_one

# Hits are sent to every task only up to this many rows.
SMALL_HITS = 1_000_000


def enrich(
    hits: DataFrame,
    documents: DataFrame,
    tracks: DataFrame,
    links: DataFrame,
    features: DataFrame,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One result row per hit.

    The side tables are first reduced to the hit songs, then to one value per song (the
    largest, where a song has several rows), and only then joined. Pass hits that have been
    cut (session.cut) or read from a table: they are used once per side table.
    """
    is_small = hits.count() <= SMALL_HITS
    ids = hits.select("song_id").distinct()

    def of_hits(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(ids) if is_small else ids, "song_id", "left_semi")

    def largest(df: DataFrame, column: str) -> DataFrame:
        rows = df.select(F.col("song_id").cast("string").alias("song_id"), column)
        return of_hits(rows).groupBy("song_id").agg(F.max(column).alias(f"new_{column}"))

    shown = of_hits(
        documents.select("song_id", "song_name", "name_artists", "spotify_url", "popularity", "energy", "lyrics")
    )
    known = ids.join(shown, "song_id", "left")
    for side, column in ((tracks, "release_date"), (links, "youtube_music_url"), (features, "energy")):
        known = known.join(largest(side, column), "song_id", "left")
    # One song may be a hit of very many queries.
    joined = join_many_to_one(hits, known, ["song_id"], ["query_id"], "left", hot_rows)
    nothing = F.lit(None).cast("string")
    return joined.select(
        "query_id",
        "rank",
        "song_id",
        F.coalesce("song_name", F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce("name_artists", F.lit(DEFAULT_ARTIST)).alias("artist"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("matched_queries", F.array().cast("array<string>")).alias("matched_queries"),
        "spotify_url",
        # The document holds neither of these two, so the fallback is null.
        or_else(F.col("new_youtube_music_url"), nothing, "").alias("youtube_music_url"),
        "popularity",
        or_else(F.col("new_release_date"), nothing, "").alias("release_date"),
        or_else(F.col("new_energy"), F.col("energy"), 0).alias("energy"),
        "lyrics",
        nothing.alias("reason"),
    )
