"""Mixing sources to target weights by pivotal dependent rounding, with built-in functions only.

Sources get their shares by weight; a target stops at `most` times the size of its source and the
excess goes to the others. A document of a source is then worth target / size copies. The whole part
of that number is certain; the fraction is a probability. Probabilities are rounded in pairs: words
of expected copies move at random from one document to the other until one of the two is certain,
which keeps the expected copies of each document and the words of both together. What is left of a
block of documents goes on to the next level of a tree, until one document of a source is left; these
meet over the sources in the same way, and the last one of all is drawn. So a source is off its
target by no more than that one document, and all sources together likewise.

Blocks take documents by hash and go from the largest to the smallest, so that the one left over
tends to be small. Random numbers are hashes of the two documents, so a run again gives the same mix.

Defined results:
- A missing text, or one of white space only, has size 0; such a document is taken 0 times.
- A missing source is a source of its own, after all others. Sources without words have target 0.
- Rows equal in id, text and source share the copies of all of them: their whole part is certain,
  the rest is one more document to be rounded. Such rows are counted, not gathered.
- An empty table gives an empty result. Texts of any length are counted in place, in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import BLANKS, join_small, row_of
from cadenza.session import cut

# Fixed value: a word is a run of anything but white space.
WORD = r"[^\x20\x09-\x0D]+"
# Weights of the sources in order, again and again, and the size of the mix.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
# Documents rounded one after the other in one row of a level.
BLOCK = 64
# Equal rows put out in one go.
RUN = 1000
# Of a hash, what a double holds exactly.
UNIT = 1 << 53
KEY = ["source", "doc_id", "text_hash", "size"]


def word_count(text: Column) -> Column:
    """Number of words, from a text with one sign for each."""
    bare = F.ltrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.char_length(F.regexp_replace(bare, WORD + r"[\x20\x09-\x0D]*+", "x")).cast("long")


def ordered_sources(sources: DataFrame) -> DataFrame:
    """sources with their place by code point (missing last), counted by ranges."""
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last())
    held = cut(dealt.withColumn("__part", F.spark_partition_id()))
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())
    placed = held.withColumn("__at", F.row_number().over(inside) - 1).join(F.broadcast(starts), "__part")
    return placed.withColumn("place", F.col("__at") + F.col("__start")).drop("__part", "__at", "__start")


def source_targets(
    groups: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size, target of every source of groups (source, size, n).

    The targets are min(most * size, level * weight) for the level at which they sum to `share` of
    all sizes. It is raised from pass to pass, each a sum over the sources, until no more of them stop.
    """
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.get(listed, F.pmod("place", F.lit(len(weights))).cast("int"))
    placed = cut(ordered_sources(sizes).withColumn("weight", weight))
    limit = F.col("source_size") * F.lit(float(most))
    whole = placed.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, None
    while True:
        stops = (limit <= F.lit(level) * F.col("weight")) if stopped is not None else F.lit(False)
        n, held, left = placed.agg(
            F.count(F.when(stops, 1)), F.sum(F.when(stops, limit).otherwise(0.0)), F.sum(F.when(stops, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == stopped or not left:
            break
        stopped = n
        level = max(level, (share * whole - held) / left)
    target = F.least(limit, F.lit(level) * F.col("weight")) if stopped is not None else F.lit(0.0)
    return placed.select("source", "source_size", target.alias("target"))


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _met(state: Column, item: Column, seed: int) -> Column:
    """Round two documents against each other; the one that becomes certain joins `done`."""
    mine, other = state["size"].cast("double"), item["size"].cast("double")
    x, y = state["p"], item["p"]
    gain = F.least((1 - x) * mine, y * other)
    loss = F.least(x * mine, (1 - y) * other)
    drawn = F.pmod(F.xxhash64(state["item"], item["item"], F.lit(seed)), F.lit(UNIT)) / F.lit(float(UNIT))

    def settled(who: Column, taken: Column) -> Column:
        return F.array_append(state["done"], F.struct(who["item"].alias("item"), taken.alias("taken")))

    def left(who: Column, p: Column, done: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        return F.struct(who["item"].alias("item"), who["size"].alias("size"), p.alias("p"), done.alias("done"))

    def rounded(moved: Column) -> Column:
        up = moved["drawn"] * (moved["gain"] + moved["loss"]) < moved["loss"]
        full = (1 - x) * mine <= y * other
        empty = x * mine <= (1 - y) * other
        return (
            F.when(up & full, left(item, y - moved["gain"] / other, settled(state, F.lit(1))))
            .when(up, left(state, x + moved["gain"] / mine, settled(item, F.lit(0))))
            .when(empty, left(item, y + moved["loss"] / other, settled(state, F.lit(0))))
            .otherwise(left(state, x - moved["loss"] / mine, settled(item, F.lit(1))))
        )

    return _bound(F.struct(gain.alias("gain"), loss.alias("loss"), drawn.alias("drawn")), rounded)


def _level(items: DataFrame, groups: list[str], blocks: Column, seed: int) -> DataFrame:
    """Blocks of items rounded from the largest to the smallest: left over (item, size, p), done."""
    block = F.pmod(F.xxhash64("item", F.lit(seed)), blocks)
    order = F.struct((-F.col("size")).alias("by"), F.xxhash64("item").alias("tie"), "item", "size", "p")
    dealt = items.withColumn("block", block).groupBy(*groups, "block").agg(F.sort_array(F.collect_list(order)).alias("all"))
    first = F.col("all")[0]
    none = F.array().cast("array<struct<item:bigint,taken:int>>")
    begin = F.struct(first["item"].alias("item"), first["size"].alias("size"), first["p"].alias("p"), none.alias("done"))
    rest = F.slice("all", 2, F.size("all"))
    return dealt.select(*groups, F.aggregate(rest, begin, lambda state, item: _met(state, item, seed)).alias("end"))


def rounded(items: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """item, taken (0 or 1) for every item (item, group, size, p) with 0 < p < 1 and size > 0.

    `item` is a number that no two items share. Each level of the tree is written.
    """
    # Whatever is left of the groups meets as a single group, so the last levels take all items.
    now, found, level = items.select("item", F.col("group"), "size", "p"), [], seed
    over_all = False
    while True:
        # Written before they are joined; a group stands once in them.
        counts = cut(now.groupBy("group").agg(F.count(F.lit(1)).alias("members")))
        top = counts.agg(F.max("members")).first()[0]
        if not top:
            break
        if top == 1 and not over_all:
            now, over_all = now.withColumn("group", F.lit(0).cast("long")), True
            continue
        if top == 1:
            # The very last one is drawn by itself.
            drawn = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(UNIT)) / F.lit(float(UNIT))
            found.append(now.select("item", (drawn < F.col("p")).cast("int").alias("taken")))
            break
        sized = join_small(now, counts, ["group"], ["item"], missing=False)
        ends = cut(_level(sized, ["group"], F.ceil(F.col("members") / F.lit(block)), level))
        found.append(ends.select(F.inline("end.done")))
        now = ends.select("end.item", "group", "end.size", "end.p")
        level += 1
    if not found:
        return items.select("item", F.lit(0).alias("taken"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole


def planned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, text_hash, source, size, n, source_size, target, copies, extra of every different row.

    Each of the n equal rows is taken `copies` times, and the first `extra` of them once more.
    """
    rows = docs.select(*row_of(id_col, text_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    groups = cut(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
    sources = cut(source_targets(groups, weights, share, most))
    met = join_small(groups, sources, ["source"], ["doc_id", "text_hash"])
    # No more than `most` copies, so that no limit is passed by a rounding error.
    each = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    met = met.withColumn("copies", F.floor(each).cast("long")).withColumn("more", (each - F.floor(each)) * F.col("n"))
    met = met.withColumn("sure", F.floor("more").cast("long")).withColumn("p", F.col("more") - F.floor("more"))
    # Numbers of rows hold for the written table.
    met = cut(met.withColumn("item", F.monotonically_increasing_id()))
    # Items are named by their content, so that the numbers do not matter for what is drawn.
    name = F.xxhash64(*KEY)
    open_items = met.filter("p > 0 AND p < 1 AND size > 0").select(name.alias("item"), F.xxhash64("source").alias("group"), "size", "p")
    drawn = rounded(open_items.dropDuplicates(["item"]), seed, block).withColumnRenamed("item", "__item")
    joined = met.join(drawn, name == F.col("__item"), "left")
    extra = F.when(F.col("size") > 0, F.col("sure") + F.coalesce("taken", F.lit(0))).otherwise(0)
    return joined.select(*KEY, "n", "source_size", "target", "copies", extra.cast("long").alias("extra"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs: taken is copies times size."""
    found = cut(planned(docs, **settings))

    def listed(rows: DataFrame, at: Column) -> DataFrame:
        taken = (F.col("copies") + (at < F.col("extra")).cast("long")) * F.col("size")
        return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))

    few = found.filter(F.col("n") <= RUN).withColumn("__at", F.explode(F.expr("sequence(0L, n - 1)")))
    # Runs of very many equal rows are dealt out before they are written one by one.
    many = found.filter(F.col("n") > RUN).withColumn("__run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
    many = many.repartition(*KEY, "__run").withColumn("__at", F.explode(F.expr(f"sequence(__run * {RUN}, least(n, (__run + 1) * {RUN}) - 1)")))
    return listed(few, F.col("__at")).union(listed(many, F.col("__at")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as they were."""
    found = planned(docs, id_col, text_col, source_col, **settings)
    total = (F.col("copies") * F.col("n") + F.col("extra")).alias("__total")
    wanted = cut(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("source").alias("__source"), total))
    row_id, row_hash = row_of(id_col, text_col)
    marked = docs.withColumn("__row_hash", row_hash)
    # Equal rows were counted as one; one of them stands for all.
    once = marked.dropDuplicates([id_col, "__row_hash", source_col])
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row_hash") == F.col("__hash"))
    met = once.join(wanted.filter("__total > 0"), same & F.col(source_col).eqNullSafe(F.col("__source")))
    return met.withColumn("__copy", F.explode(F.expr("sequence(1L, __total)"))).select(*docs.columns)
