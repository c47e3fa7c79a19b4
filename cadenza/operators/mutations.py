"""Keyed table changes as joins: each takes the old table and returns the new one."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.skew import one_per_key
from cadenza.session import cut

LINK_COLUMNS = ("spotify_url", "youtube_music_url")


# Changes are sent to the table, which then stays where it is, up to so many rows and bytes.
SMALL_ROWS = 500_000
SMALL_BYTES = 32 << 20


def sent_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes when it is sent."""
    total = F.lit(16)
    for field in df.schema:
        kind, column = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith("array"):
            total += 8 * F.coalesce(F.size(column), F.lit(0))
        else:
            total += 8
    return total


def is_small(df: DataFrame) -> bool:
    """Whether a table, which is counted for it, can be sent to every task."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sent_bytes(df)), F.lit(0)).alias("bytes")).first()
    return size["n"] <= SMALL_ROWS and size["bytes"] <= SMALL_BYTES


def _both(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Full outer join on song_id with columns old_* and new_*; new has one row per song.

    A few changes go to the rows of the old table, which are not moved; those whose song was met there
    are then left out of what is added. Many are joined by shuffle.
    """
    before = old.select("song_id", *[F.col(c).alias(f"old_{c}") for c in old.columns if c != "song_id"], F.lit(True).alias("was"))
    after = cut(new.select("song_id", *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("given")))
    if not is_small(after):
        return before.join(after, "song_id", "full_outer")
    changed = before.join(F.broadcast(after), "song_id", "left")
    # No more rows than changes.
    met = cut(old.select("song_id").join(F.broadcast(after.select("song_id")), "song_id", "left_semi").distinct())
    added = after.join(F.broadcast(met), "song_id", "left_anti")
    return changed.unionByName(added, allowMissingColumns=True)


def _stamps(old: DataFrame, run_at: datetime | None, changed: Column) -> list[Column]:
    """created_at and updated_at, if the table has them. run_at is one time for the whole run."""
    if "created_at" not in old.columns:
        return []
    now = F.lit(run_at).cast("timestamp")
    return [
        F.when(F.col("was"), F.col("old_created_at")).otherwise(now).alias("created_at"),
        F.when(F.col("was") & ~changed, F.col("old_updated_at")).otherwise(now).alias("updated_at"),
    ]


def upsert_embeddings(
    old: DataFrame, new: DataFrame, run_at: datetime | None = None, keep_existing: bool = False
) -> DataFrame:
    """Insert or replace vectors by song_id. A new null replaces too, unless keep_existing.

    Of several new rows for a song the one with the largest seq counts, without that column
    the smallest vector.
    """
    if "seq" in new.columns:
        latest = new.groupBy("song_id").agg(F.max(F.struct("seq", "embedding")).alias("last"))
        new = latest.select("song_id", "last.embedding")
    else:
        new = one_per_key(new.select("song_id", "embedding"), "song_id")
    joined = _both(old, new, ["embedding"])
    given = F.coalesce("given", F.lit(False))
    takes = given & F.col("new_embedding").isNotNull() if keep_existing else given
    value = F.when(takes, F.col("new_embedding")).otherwise(F.col("old_embedding"))
    changed = takes & ~F.col("new_embedding").eqNullSafe(F.col("old_embedding"))
    return joined.select("song_id", value.alias("embedding"), *_stamps(old, run_at, changed))


def latest_links(updates: DataFrame) -> DataFrame:
    """One row per song: per column the last value that is not null (by seq, else the largest)."""
    if "seq" in updates.columns:
        def pick(c):
            return F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c]
    else:
        def pick(c):
            return F.max(c)
    return updates.groupBy("song_id").agg(*[pick(c).alias(c) for c in LINK_COLUMNS])


def upsert_links(
    old: DataFrame, updates: DataFrame, keep_empty: bool = False, run_at: datetime | None = None
) -> DataFrame:
    """Insert or update links by song_id; a null link never overwrites a given one.

    A row without any link is left out, unless keep_empty: then it is inserted.
    """
    new = latest_links(updates)
    if not keep_empty:
        new = new.filter(F.coalesce(*LINK_COLUMNS).isNotNull())
    joined = _both(old, new, list(LINK_COLUMNS))
    others = [
        F.col(f"old_{c}").alias(c)
        for c in old.columns
        if c not in ("song_id", "created_at", "updated_at", *LINK_COLUMNS)
    ]
    links = [F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in LINK_COLUMNS]
    given = F.coalesce("given", F.lit(False))
    return joined.select("song_id", *links, *others, *_stamps(old, run_at, given))


def patch_links(links: DataFrame, patch: DataFrame, run_at: datetime | None = None) -> DataFrame:
    """Set single columns of known songs; patch holds (song_id, link_column, link_value).

    Unknown songs are ignored, an unknown column is an error. Where one cell is patched twice, the
    larger value (or with a seq column the later one) wins. updated_at, if the table has it, becomes
    run_at in rows that change.
    """
    column = F.col("link_column")
    unknown = F.raise_error(F.concat(F.lit("a patch names no link column: "), F.coalesce(column, F.lit("null"))))
    patch = patch.withColumn("link_column", F.when(column.isin(*LINK_COLUMNS), column).otherwise(unknown.cast("string")))

    def cell(column: str) -> Column:
        order = F.struct("seq", "link_value") if "seq" in patch.columns else F.struct("link_value")
        return F.max(F.when(F.col("link_column") == column, order))["link_value"].alias(f"new_{column}")

    cells = patch.groupBy("song_id").agg(*[cell(c) for c in LINK_COLUMNS])
    cells = cut(cells)
    # A few cells go to the links, which stay where they are.
    joined = links.join(F.broadcast(cells) if is_small(cells) else cells, "song_id", "left")
    values = {c: F.coalesce(f"new_{c}", c) for c in LINK_COLUMNS}
    if "updated_at" in links.columns:
        changes = [F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)) for c in LINK_COLUMNS]
        now = F.lit(run_at).cast("timestamp")
        values["updated_at"] = F.when(reduce(Column.__or__, changes), now).otherwise(F.col("updated_at"))
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in links.columns])
