"""Playlists: read back in order, replace, delete, and batches of commands."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.skew import HOT_ROWS, join_many_to_one, numbered, running_total

KEY = ["user_id", "playlist_name"]
TABLE = ["id", *KEY, "song_data", "created_at", "updated_at"]
PAGE = 1000


def playlists_by_user(playlists: DataFrame, user_id: str | None = None) -> DataFrame:
    """(user_id, playlist_name, pos, song): songs of each playlist in row order.

    A row without song data keeps its playlist alive with a null song and takes no place; a
    song that is not valid JSON becomes null and is marked bad.
    """
    rows = playlists if user_id is None else playlists.filter(F.col("user_id") == user_id)
    rows = rows.select(*KEY, "id", "song_data")
    filled = F.coalesce(F.col("song_data") != "", F.lit(False))
    songs = numbered(rows.filter(filled), KEY, "id", [], "pos")
    parsed = F.try_parse_json("song_data")
    songs = songs.select(
        *KEY, "pos", F.when(parsed.isNotNull(), F.col("song_data")).alias("song"), parsed.isNull().alias("bad")
    )
    # Playlist names whose rows are all empty: a count per name, combined before the shuffle.
    counts = rows.groupBy(*KEY).agg(F.count_if(filled).alias("n"))
    names = counts.filter("n = 0").select(
        *KEY, F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("song"), F.lit(False).alias("bad")
    )
    return songs.unionByName(names)


def playlist_pages(playlists: DataFrame, user_id: str | None = None, page: int = PAGE) -> DataFrame:
    """(user_id, playlist_name, page_no, songs, n_bad): arrays of at most `page` songs each.

    A song that is not valid JSON is left out and counted; its playlist and its place stay.
    """
    rows = playlists_by_user(playlists, user_id)
    page_no = F.coalesce(F.floor(F.col("pos") / page), F.lit(0)).alias("page_no")
    entry = F.when(F.col("song").isNotNull(), F.struct("pos", "song"))
    ordered = F.array_sort(F.collect_list(entry))
    return rows.groupBy(*KEY, page_no).agg(
        F.transform(ordered, lambda e: e["song"]).alias("songs"), F.count_if("bad").alias("n_bad")
    )


def _last_commands(commands: DataFrame) -> DataFrame:
    """The command with the largest seq per playlist."""
    last = commands.groupBy(*KEY).agg(F.max(F.struct("seq", "op", "songs")).alias("last"))
    return last.select(*KEY, "last.seq", "last.op", "last.songs")


def apply_playlist_commands(
    playlists: DataFrame,
    commands: DataFrame,
    hot_rows: int = HOT_ROWS,
    run_at: datetime | None = None,
    top: int | None = None,
) -> DataFrame:
    """The table after all commands, with the columns it came with.

    commands hold (seq, op, user_id, playlist_name, songs) with op replace or delete; the last
    command per playlist counts. Replacing by no songs deletes. New rows get the ids after the
    largest old one, in order of command and song, and run_at as their times. Give that id as `top`
    where playlists are only a part of the table.
    """
    columns = [c for c in TABLE if c in playlists.columns]
    last = _last_commands(commands)
    kept = join_many_to_one(playlists.select(*columns), last.select(*KEY), KEY, ["id"], "left_anti", hot_rows)
    # Commands are numbered by the songs before them; only then do their songs become rows.
    replaced = last.filter((F.col("op") == "replace") & (F.size("songs") > 0))
    added = running_total(replaced, "seq", KEY, F.size("songs"), "before")
    added = added.select("before", *KEY, F.posexplode("songs").alias("place", "song_data"))
    largest = playlists.agg(F.coalesce(F.max("id"), F.lit(-1)).cast("long")).scalar() if top is None else F.lit(top)
    now = F.lit(run_at).cast("timestamp")
    new = added.select(
        (largest + F.col("before") + F.col("place") + 1).alias("id"), *KEY, "song_data",
        now.alias("created_at"), now.alias("updated_at"),
    )
    kept = kept.withColumn("id", F.col("id").cast("long"))
    return kept.select(*columns).unionByName(new.select(*columns))


def replace_playlist(playlists: DataFrame, user_id: str, name: str, songs: list[str]) -> DataFrame:
    """Replace one playlist by the given songs (JSON text), or delete it if there are none."""
    spark = playlists.sparkSession
    command = spark.createDataFrame(
        [(0, "replace", user_id, name, songs)],
        "seq long, op string, user_id string, playlist_name string, songs array<string>",
    )
    return apply_playlist_commands(playlists, command)


def delete_playlist(playlists: DataFrame, user_id: str, name: str) -> DataFrame:
    """Drop one playlist; an unknown one changes nothing."""
    gone = (F.col("user_id") == user_id) & (F.col("playlist_name") == name)
    return playlists.filter(~F.coalesce(gone, F.lit(False)))
