"""Songs found by a part of their name, through an index of all runs of three characters.

A name that contains a text contains all its runs of three. The lists of the rarest of these are
read and intersected, and the songs that are left are looked up in their buckets and compared in
full, so the rows are those of a scan. Texts under three characters, and texts whose rarest run is in
too many names to save anything, are looked for by a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.text import collation_key
from cadenza.sources import bucket_table as bt, clustered as cl

RUN = 3
# Lists that are intersected, and runs of a text among which the rarest are sought.
LISTS, RUNS_ASKED = 4, 64
RUNS_PER_FILE = 5_000_000
# A rarest run in more than one name of so many is left to a scan.
RARE = 8
# Ids sent to every task, up to so many; beyond, they are joined by shuffle.
SMALL_IDS = 100_000
# What two names must share to count as the same letters.
FOLDS = {"case": F.lower, "collation": collation_key}


def runs(text: Column) -> Column:
    """The different runs of three characters of a text; none for null and for shorter ones."""
    none = F.array().cast("array<string>")

    def cut(signs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(signs) - RUN)
        found = F.transform(starts, lambda i: F.concat(*[F.get(signs, i + k) for k in range(RUN)]))
        return F.when(F.size(signs) >= RUN, F.array_distinct(found)).otherwise(none)

    # Bound to a variable, the signs are told apart once and not once for every run.
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), cut), 0)


def save_names(songs: DataFrame, path: str, fold: str = "case") -> None:
    """Index songs (song_id, song_name, ...) under path.

    Songs without a name are kept and never found. Repeated ids and rows are kept as they are. A run
    that very many names share spans several files.
    """
    spark = songs.sparkSession
    key = FOLDS[fold]
    lists = songs.select(F.explode(runs(key(F.col("song_name")))).alias("run"), "song_id")
    counts = lists.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    n_songs, n_entries = songs.agg(F.count(F.lit(1)), F.sum(F.size(runs(key(F.col("song_name")))))).first()
    cl.save(lists, f"{path}/lists", ["run", "song_id"], cl.files_for(spark, n_entries or 0, RUNS_PER_FILE), ["run"])
    cl.save(counts, f"{path}/counts", ["run"], cl.files_for(spark, 0), ["run"])
    buckets = cl.files_for(spark, n_songs)
    state = {"n_songs": n_songs, "fold": list(FOLDS).index(fold)}
    bt.create(songs, f"{path}/songs", ["song_id"], buckets, state)


def _rarest(spark: SparkSession, path: str, text: Column) -> tuple[list[str], int] | None:
    """The rarest runs of a text and in how many names the rarest is; None for a text without runs."""
    asked = spark.range(1).select(runs(text).alias("runs")).first()["runs"]
    if not asked:
        return None
    step = -(-len(asked) // RUNS_ASKED)
    asked = asked[::step]
    held = cl.read(spark, f"{path}/counts", {"run": [(run, run) for run in asked]}).collect()
    if len(held) < len(asked):
        return [], 0
    best = sorted(held, key=lambda row: (row.n, row.run))[:LISTS]
    return [row.run for row in best], best[0].n


def candidates(spark: SparkSession, path: str, chosen: list[str]) -> DataFrame:
    """(song_id) of the songs that are in all of the chosen lists."""
    met = cl.read(spark, f"{path}/lists", {"run": [(run, run) for run in chosen]})
    # An id with several names is counted once for each, so no song is lost; names are compared later.
    return met.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= len(chosen)).select("song_id")


def songs_containing(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The songs whose name contains a text, by the letters that the index was made with."""
    held = bt.manifest(spark, f"{path}/songs")
    key = list(FOLDS.values())[held.state["fold"]]
    wanted = F.contains(key(F.col("song_name")), key(F.lit(text)))

    def songs(only: list[int] | None = None) -> DataFrame:
        return bt.read(spark, f"{path}/songs", held.version, only).filter(wanted)

    rarest = _rarest(spark, path, key(F.lit(text)))
    if rarest is None:
        return songs()
    chosen, n = rarest
    if not chosen:
        return songs([])
    if n * RARE > held.state["n_songs"]:
        return songs()
    found = candidates(spark, path, chosen)
    if n > SMALL_IDS:
        ids = found.select(F.col("song_id").alias("__id"))
        return songs().join(ids, F.col("song_id").eqNullSafe(F.col("__id")), "left_semi")
    ids = found.select(F.col("song_id").alias("__id"))
    near = songs(bt.touched(found, held))
    return near.join(F.broadcast(ids), F.col("song_id").eqNullSafe(F.col("__id")), "left_semi")
