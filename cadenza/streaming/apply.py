"""The table changes, fed by files that keep arriving.

The table and the last sequence number applied per key are kept as buckets. A batch reads and rewrites
only the buckets of its keys, so what it costs follows its size, not the table's. A version is named
after its batch, so a batch repeated after a failure overwrites only its own output. Late or repeated
commands carry a number that is not larger than the last one of their key and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.operators import playlists as pl
from cadenza.operators.mutations import LINK_COLUMNS, upsert_links
from cadenza.operators.skew import join_many_to_one
from cadenza.session import cut
from cadenza.sources import bucket_table as bt

COMMANDS = "seq long, op string, user_id string, playlist_name string, songs array<string>"
LINK_UPDATES = "seq long, song_id string, spotify_url string, youtube_music_url string"


BUCKETS = 64
LINK_SEEN = "song_id string, link_column string"
PLAYLIST_SEEN = "user_id string, playlist_name string"


def _largest_id(rows: DataFrame, least: int) -> int:
    return max(least, rows.agg(F.coalesce(F.max("id"), F.lit(-1)).cast("long").alias("top")).first()["top"])


def create_links(rows: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    create_table(rows, table, ["song_id"], LINK_SEEN, buckets)


def create_playlists(rows: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    create_table(rows, table, pl.KEY, PLAYLIST_SEEN, buckets)


def read_rows(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The table after a batch, or after the last one that is complete."""
    return bt.read(spark, _rows(table), newest_version(spark, table) if version is None else version)


def _rows(table: str) -> str:
    return f"{table}/rows"


def _seen(table: str) -> str:
    return f"{table}/seen"


def create_table(rows: DataFrame, table: str, keys: list[str], seen: str, buckets: int = BUCKETS) -> None:
    """Write the table as it is before the first batch (version -1), in buckets of `keys`.

    seen: the columns, beside seq, by which numbers are compared, as a schema; keys are among them.
    """
    # The largest id ever given, as ids are not used again.
    state = {"top": _largest_id(rows, -1)} if "id" in rows.columns else {}
    bt.create(rows, _rows(table), keys, buckets, state)
    bt.create(rows.sparkSession.createDataFrame([], f"{seen}, seq long"), _seen(table), keys, buckets)


def _link_cells(updates: DataFrame) -> DataFrame:
    """One row per link given: (seq, song_id, link_column, link_value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("link_column"), F.col(c).alias("link_value")) for c in LINK_COLUMNS])
    return updates.select("seq", "song_id", F.inline(pairs)).filter("link_value IS NOT NULL")


def _apply_commands(old: DataFrame, commands: DataFrame, state: dict[str, int]) -> DataFrame:
    return pl.apply_playlist_commands(old, commands, top=state["top"])


def _upsert_cells(old: DataFrame, cells: DataFrame, _state: dict[str, int]) -> DataFrame:
    values = [F.when(F.col("link_column") == c, F.col("link_value")).alias(c) for c in LINK_COLUMNS]
    return upsert_links(old, cells.select("seq", "song_id", *values))


def _apply_stream(
    source: DataFrame,
    table: str,
    checkpoint: str,
    keys: list[str],
    split: Callable[[DataFrame], DataFrame],
    change: Callable[[DataFrame, DataFrame, dict[str, int]], DataFrame],
) -> StreamingQuery:
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, seen = _rows(table), _seen(table)
        # A query started again has batch numbers for which nothing was written.
        last_version = max(v for v in bt.versions(spark, seen) if v < number)
        before, known = (bt.manifest(spark, path, last_version) for path in (rows, seen))
        given = cut(split(batch))
        buckets = bt.touched(given, before)
        numbers = bt.read(spark, seen, last_version, buckets)
        met = join_many_to_one(given, numbers.withColumnRenamed("seq", "last_seq"), keys, ["seq"])
        fresh = met.filter(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))).drop("last_seq")
        after = change(bt.read(spark, rows, last_version, buckets), fresh, before.state)
        # The largest id follows from what was written, before the manifest names it.
        top = before.state.get("top")
        if top is not None:
            after = cut(after)
            top = _largest_id(after, top)
        bt.rewrite(spark, rows, before, number, buckets, after, {} if top is None else {"top": top})
        newest = given.select(*keys, "seq").unionByName(numbers.select(*keys, "seq")).groupBy(*keys).agg(F.max("seq").alias("seq"))
        bt.rewrite(spark, seen, known, number, buckets, newest)

    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _arriving(spark: SparkSession, schema: str, inbox: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(inbox)


def newest_version(spark: SparkSession, table: str) -> int:
    """Number of the last version that is complete; -1 before the first batch.

    It is read from the table itself: a query started again without new files has batch numbers
    for which nothing was written. The numbers seen are written last, so they mark a whole version.
    """
    return bt.versions(spark, _seen(table))[-1]


def drop_versions(spark: SparkSession, table: str, keep: int = 2) -> list[int]:
    """Delete all but the last `keep` complete versions and give the numbers of those deleted.

    The last one is what the next batch starts from, so at least one stays, and so do older files that
    it still names. A reader of an older version fails; call this when there are none.
    """
    bt.drop(spark, _rows(table), keep)
    return bt.drop(spark, _seen(table), keep)


def stream_playlist_commands(
    spark: SparkSession, inbox: str, table: str, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Apply all playlist commands that have arrived in inbox, then stop."""
    source = _arriving(spark, COMMANDS, inbox, files_per_batch)
    return _apply_stream(source, table, checkpoint, pl.KEY, lambda b: b, _apply_commands)


def stream_link_updates(
    spark: SparkSession, inbox: str, table: str, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Apply all link updates that have arrived in inbox, then stop."""
    source = _arriving(spark, LINK_UPDATES, inbox, files_per_batch)
    return _apply_stream(source, table, checkpoint, ["song_id", "link_column"], _link_cells, _upsert_cells)
