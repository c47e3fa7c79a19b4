"""Building blocks that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key with more rows than this is split. A table of n rows has at most n / HOT_ROWS such
# keys, so the list of hot keys is small enough to broadcast at any size of the table.
HOT_ROWS = 1_000_000
NULL_PARTS = 10_000
SALT = "__salt"
PARTS = "__parts"


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than hot_rows rows and the number of parts each is split into."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    parts = F.ceil(F.col("__rows") / hot_rows).cast("int").alias(PARTS)
    return counts.filter(F.col("__rows") > hot_rows).select(*on, parts)


def spread_hot(df: DataFrame, hot: DataFrame, on: list[str], row_key: list[Column]) -> DataFrame:
    """Give every row of a hot key one of the key's parts; a null key meets nothing anywhere."""
    row = F.xxhash64(*row_key)
    part = F.when(F.col(on[0]).isNull(), F.pmod(row, F.lit(NULL_PARTS))).otherwise(
        F.pmod(row, F.coalesce(PARTS, F.lit(1)))
    )
    part = part.cast("int")
    return df.join(F.broadcast(hot), on, "left").withColumn(SALT, part)


def copy_hot(df: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Repeat every row of a hot key once per part."""
    parts = F.sequence(F.lit(0), F.coalesce(PARTS, F.lit(1)) - 1)
    return df.join(F.broadcast(hot), on, "left").withColumn(SALT, F.explode(parts))


def join_many_to_one(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    row_key: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """left JOIN right (inner, left, left_semi or left_anti) with hot keys of left split.

    Every left row meets exactly one copy of each right row, so the result is that of the
    plain join, whichever keys are split. row_key spreads the rows of one key and must differ
    between them. Give `hot` (see hot_keys) where counting left itself would repeat much work;
    counting a larger table in its place is fine.
    """
    if hot is None:
        hot = hot_keys(left.filter(F.col(on[0]).isNotNull()), on, hot_rows)
    spread = spread_hot(left, hot, on, [F.col(c) for c in row_key]).drop(PARTS)
    copies = copy_hot(right, hot, on).drop(PARTS)
    return spread.join(copies, [*on, SALT], how).drop(SALT)


def join_in_parts(
    left: DataFrame, right: DataFrame, on: list[str], row_key: list[str], parts: int = 64
) -> DataFrame:
    """left JOIN right with every key split into the same number of parts.

    For a left side that is costly to count and a right side small enough to repeat.
    """
    spread = left.withColumn(SALT, F.pmod(F.xxhash64(*row_key), F.lit(parts)).cast("int"))
    copies = right.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread.join(copies, [*on, SALT]).drop(SALT)


def join_one_to_many(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    row_key: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """left LEFT JOIN right with hot keys of right split.

    A hot key has partners by definition, so a copy of its left row that meets none is
    dropped; all other left rows have a single copy and stay.
    """
    hot = hot_keys(right.filter(F.col(on[0]).isNotNull()), on, hot_rows)
    copies = copy_hot(left, hot, on)
    spread = spread_hot(right, hot, on, [F.col(c) for c in row_key]).drop(PARTS)
    joined = copies.join(spread.withColumn("__met", F.lit(True)), [*on, SALT], "left")
    keep = F.col(PARTS).isNull() | F.col("__met").isNotNull()
    return joined.filter(keep).drop(SALT, PARTS, "__met")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """The smallest row of every key, nulls last; partial results combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    ordered = F.struct(*[f(c).alias(f"{tag}_{c}") for c in rest for tag, f in (("n", F.isnull), ("v", F.col))])
    best = df.groupBy(key).agg(F.min(ordered).alias("__best"))
    return best.select(key, *[F.col(f"__best.v_{c}").alias(c) for c in rest]).select(*df.columns)


def numbered(
    df: DataFrame,
    groups: list[str],
    order: str,
    ties: list[str],
    name: str,
    width: int = 65_536,
) -> DataFrame:
    """Add the 0-based position of each row within its group.

    order is a whole number. Rows are counted per block of `width` order values, block
    offsets are a running sum over the blocks, and rows are ranked inside their block only, so
    no task ever holds a whole group.
    """
    rows = df.withColumn("__block", F.expr(f"`{order}` div {width}"))
    keys = [*groups, "__block"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # Blocks of blocks: the running sum inside one of them covers at most `width` rows.
    outer = counts.withColumn("__outer", F.expr(f"__block div {width}"))
    outer_keys = [*groups, "__outer"]
    totals = outer.groupBy(*outer_keys).agg(F.sum("__n").alias("__total"))
    whole = Window.partitionBy(*groups).orderBy("__outer").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("__start", F.coalesce(F.sum("__total").over(whole), F.lit(0))).drop("__total")
    inside = Window.partitionBy(*outer_keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("__n").over(inside), F.lit(0))
    offsets = (
        outer.withColumn("__within", within)
        .join(starts, outer_keys)
        .select(*keys, (F.col("__within") + F.col("__start")).alias("__offset"))
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties)) - 1
    return (
        rows.withColumn("__rank", rank)
        .join(offsets, keys)
        .withColumn(name, (F.col("__rank") + F.col("__offset")).cast("long"))
        .drop("__block", "__rank", "__offset")
    )


def running_total(df: DataFrame, order: str, ties: list[str], amount: Column, name: str, width: int = 65_536) -> DataFrame:
    """Add the sum of `amount` over all rows before each row, in the order of whole numbers.

    Amounts are summed per block of `width` order values and per block of such blocks; a task holds
    the rows of one block, and one last task a total for every 2**32 order values that occur.
    """
    rows = df.withColumn("__amount", amount.cast("long")).withColumn("__block", F.expr(f"`{order}` div {width}"))
    sums = rows.groupBy("__block").agg(F.sum("__amount").alias("__sum")).withColumn("__outer", F.expr(f"__block div {width}"))
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.groupBy("__outer").agg(F.sum("__sum").alias("__total"))
    start = F.coalesce(F.sum("__total").over(before(Window.orderBy("__outer"))), F.lit(0))
    starts = totals.select("__outer", start.alias("__start"))
    within = F.coalesce(F.sum("__sum").over(before(Window.partitionBy("__outer").orderBy("__block"))), F.lit(0))
    offsets = sums.withColumn("__within", within).join(starts, "__outer")
    offsets = offsets.select("__block", (F.col("__within") + F.col("__start")).alias("__offset"))
    inside = F.coalesce(F.sum("__amount").over(before(Window.partitionBy("__block").orderBy(order, *ties))), F.lit(0))
    met = rows.withColumn("__inside", inside).join(offsets, "__block")
    return met.withColumn(name, F.col("__inside") + F.col("__offset")).drop("__amount", "__block", "__inside", "__offset")
