"""Counts, coverage and inspection queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import collation_key
from cadenza.operators.matching import with_albums


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def link_coverage(links: DataFrame) -> DataFrame:
    """One row: filled and missing links of both services, with percentages."""
    total = F.count(F.lit(1))

    def figures(column: str, tag: str) -> list[Column]:
        missing, filled = F.count_if(F.col(column).isNull()), F.count_if(F.col(column).isNotNull())

        def share(n: Column) -> Column:
            return F.round(F.try_divide(n, total) * 100, 2)

        return [
            missing.alias(f"{tag}_null"),
            share(missing).alias(f"{tag}_null_pct"),
            filled.alias(f"{tag}_not_null"),
            share(filled).alias(f"{tag}_not_null_pct"),
        ]

    return links.agg(total.alias("total"), *figures("spotify_url", "sp"), *figures("youtube_music_url", "yt"))


def linked_songs_like(
    songs: DataFrame, tracks: DataFrame, albums: DataFrame, links: DataFrame, text: str, limit: int | None = None
) -> DataFrame:
    """Songs whose name contains text in any case and that have both links, with their albums."""
    named = songs.select("song_id", "song_name", "artists").filter(
        F.contains(F.lower("song_name"), F.lower(F.lit(text)))
    )
    both = links.select("song_id", "spotify_url", "youtube_music_url").filter(
        F.col("spotify_url").isNotNull() & F.col("youtube_music_url").isNotNull()
    )
    # The test on the links makes that join an inner one, so it comes first.
    linked = named.join(both, "song_id")
    rows = with_albums(linked, tracks, albums)
    rows = rows.select("song_id", "song_name", "artists", "album_name", "spotify_url", "youtube_music_url")
    return rows if limit is None else rows.orderBy("song_id", "album_name").limit(limit)


def embedding_preview(
    songs: DataFrame, embeddings: DataFrame, text: str, shown: int = 3, limit: int | None = None
) -> DataFrame:
    """Songs whose name contains text, whatever its case and accents, with the start of their vector.

    first_values are its first entries, embedding_preview the first 50 characters as JSON.
    """
    values = F.slice("embedding", 1, shown).alias("first_values")
    preview = F.substring(F.to_json("embedding"), 1, 50).alias("embedding_preview")
    rows = (
        songs.filter(F.contains(collation_key(F.col("song_name")), collation_key(F.lit(text))))
        .join(embeddings.select("song_id", "embedding"), "song_id", "left")
        .select("song_id", "song_name", "artists", values, preview)
    )
    return rows if limit is None else rows.orderBy("song_id").limit(limit)
