"""Postings by word, for requests that should read little.

The stored index also keeps the postings of every field and word as lists, cut into blocks of about
BLOCK songs by a hash of the song. Blocks are bucketed by a number made of field, word and part, so
a filter on these numbers reads the files of the asked words only. The terms table holds the largest
impact of each list.

`best_songs` reads as little of that as the best page needs. The shortest lists of a query are summed
first; their best songs give a score that the page has at least. Long lists whose largest impacts
together stay below it cannot bring a song onto the page by themselves, so they are looked up only for
songs that are met in other lists and could still reach the page.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.skew import HOT_ROWS, PARTS, join_many_to_one
from cadenza.session import cut

BLOCK = 4096
SLOTS = 1 << 20
# Words with several blocks are sent to every task up to so many.
MOST_SENT = 200_000
# Blocks are named in a filter up to this many; beyond, all postings are read by song.
MOST_BLOCKS = 20_000
# Scores are rounded to six decimals before they are compared.
MARGIN = 2e-6
# Of the sum of the largest contributions, what the lists that are not read first may hold.
LEFT_FIRST = 0.5


def n_parts(df: Column) -> Column:
    return F.ceil(df / F.lit(BLOCK)).cast("long")


def part_of(song: Column, parts: Column) -> Column:
    """The part of a list that a song is in, for a list of so many parts."""
    slot = F.pmod(F.xxhash64(song), F.lit(SLOTS).cast("long"))
    return F.floor(slot * parts / F.lit(SLOTS)).cast("long")


def block_number() -> Column:
    return F.xxhash64("field", "term", "part")


def term_lists(postings: DataFrame, terms: DataFrame, buckets: int) -> DataFrame:
    """(block, field, term, part, songs, impacts): the postings of every word in blocks, dealt to so
    many buckets by block.

    terms (field, term, df) belong to the same postings. Only words with more than one part need to be
    known while postings are dealt; there is at most one for every BLOCK postings. Postings are
    shuffled once, to the buckets that their blocks are written to.
    """
    on = ["field", "term"]
    held = postings.select("song_id", *on, "impact")
    long = terms.filter(F.col("df") > BLOCK).select(*on, n_parts(F.col("df")).alias("parts"))
    if long.limit(MOST_SENT + 1).count() <= MOST_SENT:
        sized = held.join(F.broadcast(long), on, "left")
    else:
        hot = terms.filter(F.col("df") > HOT_ROWS).select(*on, F.ceil(F.col("df") / HOT_ROWS).cast("int").alias(PARTS))
        sized = join_many_to_one(held, long, on, ["song_id"], hot=hot)
    dealt = sized.withColumn("part", part_of(F.col("song_id"), F.coalesce("parts", F.lit(1)).cast("long"))).drop("parts")
    dealt = dealt.withColumn("block", block_number()).repartition(buckets, "block")
    # A part has about BLOCK songs, whatever the length of its list.
    blocks = dealt.groupBy("block", *on, "part").agg(F.sort_array(F.collect_list(F.struct("song_id", "impact"))).alias("held"))
    return blocks.select("block", *on, "part", F.col("held.song_id").alias("songs"), F.col("held.impact").alias("impacts"))


@dataclass(frozen=True)
class AskedList:
    """A list that a query asks for: its length, and the most that it can add to a score."""

    query_id: object
    field: str
    term: str
    df: int
    most: float


def _asked(index, weights: DataFrame) -> DataFrame:
    """weights (query_id, field, term, keyword, prompt) with df and the largest contribution."""
    facts = index.terms.select("field", "term", "df", "most")
    met = facts.join(F.broadcast(weights), ["field", "term"])
    return met.withColumn("most", F.col("most") * (F.col("keyword") + F.col("prompt")))


def blocks_of(index, lists: DataFrame) -> DataFrame | None:
    """The stored blocks of the given lists (field, term, parts or part); None if they are too many."""
    if "part" not in lists.columns:
        lists = lists.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    numbers = lists.select(block_number().alias("block")).distinct().limit(MOST_BLOCKS + 1).collect()
    if len(numbers) > MOST_BLOCKS:
        return None
    return index.lists.filter(F.col("block").isin([r.block for r in numbers]))


def _postings(blocks: DataFrame) -> DataFrame:
    pairs = F.arrays_zip("songs", "impacts")
    return blocks.select("field", "term", F.inline(pairs)).select("field", "term", F.col("songs").alias("song_id"), F.col("impacts").alias("impact"))


def _summed(postings: DataFrame, weights: DataFrame) -> DataFrame:
    met = postings.join(F.broadcast(weights), ["field", "term"])
    return met.groupBy("query_id", "song_id").agg(
        F.sum(F.col("impact") * F.col("keyword")).alias("keyword"), F.sum(F.col("impact") * F.col("prompt")).alias("prompt")
    )


def asked_postings(index, weights: DataFrame) -> DataFrame | None:
    """The postings of all words that weights (field, term) name; None without stored lists or if
    they have too many blocks."""
    if index.lists is None:
        return None
    named = weights.select("field", "term").distinct()
    parts = index.terms.select("field", "term", n_parts(F.col("df")).alias("parts")).join(F.broadcast(named), ["field", "term"])
    blocks = blocks_of(index, parts)
    return None if blocks is None else _postings(blocks)


def first_lists(lists: list[AskedList]) -> list[AskedList]:
    """The shortest lists of a query, until the others can add no more than a share of all."""
    rest = sum(a.most for a in lists)
    allowed, chosen = LEFT_FIRST * rest, []
    for asked in sorted(lists, key=lambda a: (a.df, a.field, a.term)):
        if chosen and rest <= allowed:
            break
        chosen.append(asked)
        rest -= asked.most
    return chosen


def needed_lists(lists: list[AskedList], least: float) -> list[AskedList]:
    """The lists without which a song cannot score `least`: all but the longest that stay below it."""
    rest, needed = 0.0, []
    for asked in sorted(lists, key=lambda a: (-a.df, a.field, a.term)):
        rest += asked.most
        if rest >= least - MARGIN:
            needed.append(asked)
    return needed


def best_songs(index, weights: DataFrame, top: int, also: DataFrame | None = None) -> DataFrame | None:
    """(query_id, song_id, keyword, prompt) of all songs that can be among the `top` of a query.

    weights have (query_id, field, term, keyword, prompt); there is one row per word. Scores are
    complete. `also` (query_id, song_id) names songs whose scores are wanted in any case, where they
    have one. None without stored lists, or if the words have too many blocks: then read all postings.
    """
    if index.lists is None or "most" not in index.terms.columns:
        return None
    asked = cut(_asked(index, weights))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(n_parts(F.col("df"))).alias("blocks")).first()
    if size["n"] > MOST_BLOCKS or (size["blocks"] or 0) > MOST_BLOCKS:
        return None
    by_query = defaultdict(list)
    for r in asked.select("query_id", "field", "term", "df", "most").collect():
        by_query[r.query_id].append(AskedList(*r))
    spark = weights.sparkSession
    key_type = weights.schema["query_id"].dataType.simpleString()

    def listed(chosen) -> DataFrame:
        rows = [(a.query_id, a.field, a.term) for a in chosen]
        return spark.createDataFrame(rows, f"query_id {key_type}, field string, term string")

    def summed(chosen) -> DataFrame:
        mine = asked.join(F.broadcast(listed(chosen)), ["query_id", "field", "term"])
        blocks = blocks_of(index, mine.select("field", "term", n_parts(F.col("df")).alias("parts")).distinct())
        return _summed(_postings(blocks), mine.select("query_id", "field", "term", "keyword", "prompt"))

    score = F.col("keyword") + F.col("prompt")
    first = {q: first_lists(lists) for q, lists in by_query.items()}
    partial = cut(summed([a for chosen in first.values() for a in chosen]))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    ranked = partial.select("query_id", score.alias("score")).withColumn("rank", F.row_number().over(best))
    least = {r.query_id: r.score for r in ranked.filter(F.col("rank") == top).select("query_id", "score").collect()}
    # Lists that turn out to be needed are read as well; a song with fewer words has no other way in.
    read = {q: set(first[q]) for q in by_query}
    more = [a for q, lists in by_query.items() for a in needed_lists(lists, least.get(q, 0.0)) if a not in read[q]]
    if more:
        both = partial.unionByName(summed(more))
        partial = cut(both.groupBy("query_id", "song_id").agg(F.sum("keyword").alias("keyword"), F.sum("prompt").alias("prompt")))
        for a in more:
            read[a.query_id].add(a)
    rest = [a for q, lists in by_query.items() for a in lists if a not in read[q]]
    if not rest:
        return partial
    facts = [(q, least.get(q, 0.0), sum((a.most for a in lists if a not in read[q]), 0.0)) for q, lists in by_query.items()]
    limits = spark.createDataFrame(facts, f"query_id {key_type}, least double, rest double")
    near = partial.join(F.broadcast(limits), "query_id").filter(score + F.col("rest") >= F.col("least") - MARGIN)
    near = near.select("query_id", "song_id")
    able = cut(near if also is None else near.union(also.select("query_id", "song_id")).distinct())
    # Only the blocks that hold such songs are read of the other lists.
    open_lists = asked.join(F.broadcast(listed(rest)), ["query_id", "field", "term"])
    wanted = able.join(F.broadcast(open_lists), "query_id")
    wanted = wanted.withColumn("part", part_of(F.col("song_id"), n_parts(F.col("df"))))
    blocks = blocks_of(index, wanted.select("field", "term", "part").distinct())
    found = _postings(blocks).join(F.broadcast(open_lists.select("query_id", "field", "term", "keyword", "prompt")), ["field", "term"])
    found = found.join(able, ["query_id", "song_id"], "left_semi").select(
        "query_id", "song_id", (F.col("impact") * F.col("keyword")).alias("keyword"), (F.col("impact") * F.col("prompt")).alias("prompt")
    )
    whole = partial.join(able, ["query_id", "song_id"], "left_semi").select("query_id", "song_id", "keyword", "prompt").unionByName(found)
    return whole.groupBy("query_id", "song_id").agg(F.sum("keyword").alias("keyword"), F.sum("prompt").alias("prompt"))


def buckets_read(df: DataFrame) -> tuple[int, int] | None:
    """How many buckets of bucketed tables the scans of a plan read after pruning, and of how many;
    None if no scan is pruned."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    read = total = 0
    for at in range(leaves.size()):
        leaf = leaves.apply(at)
        if str(leaf.nodeName()).startswith("Scan ") and leaf.getClass().getSimpleName() == "FileSourceScanExec" and leaf.optionalBucketSet().isDefined():
            read += leaf.optionalBucketSet().get().cardinality()
            total += leaf.relation().bucketSpec().get().numBuckets()
    return (read, total) if total else None
