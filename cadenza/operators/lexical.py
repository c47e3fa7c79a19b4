"""Keyword and typo-tolerant relevance of documents for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.distance import allowed_edits, osa_within, search_keys
from cadenza.functions.text import clean_keywords, words
from cadenza.operators.index import FIELD_BOOSTS, Index, idf, key_numbers
from cadenza.operators.skew import PARTS, SALT, copy_hot, join_many_to_one, spread_hot
from cadenza.operators.term_lists import asked_postings
from cadenza.session import cut, send_with_tasks

send_with_tasks(__name__)

Provider = Callable[[Sequence[str]], Sequence[str | None]]
PROMPTS_PER_CALL = 25

# The server that is matched lets a search word stand for at most this many indexed
# words per field, and its pages hold so many hits. Both are defaults of arguments.
MAX_EXPANSIONS = 50
PAGE_SIZE = 20
# Tables that come from the queries are sent to every task only up to this many rows and bytes;
# larger ones are joined by shuffle instead.
SMALL_ROWS = 2_000_000
FEW_QUERIES = 200_000
SMALL_BYTES = 64 << 20
# Bytes of a row besides its texts.
ROW_BYTES = 64
# Postings of a word times queries asking for it, above which the word is split.
PAIRS_PER_TASK = 50_000_000


@dataclass(frozen=True)
class BatchSize:
    """What a batch of queries holds, counted before anything is broadcast."""

    queries: int
    words: int
    keys: int
    largest_page: int
    filter_bytes: int
    word_bytes: int
    key_bytes: int

    @property
    def few_queries(self) -> bool:
        return self.queries <= FEW_QUERIES and self.filter_bytes <= SMALL_BYTES

    @property
    def small_words(self) -> bool:
        return self.words <= SMALL_ROWS and self.word_bytes <= SMALL_BYTES

    @property
    def small_keys(self) -> bool:
        return self.keys <= SMALL_ROWS and self.key_bytes <= SMALL_BYTES


def batch_size(queries: DataFrame, page: int = PAGE_SIZE) -> BatchSize:
    """Queries, their words (prompt and keywords), lookup keys of the different prompt words, and
    the largest page asked for (page, unless queries have a size column), with the bytes of each as
    they would be sent. Queries without a keywords column may get each prompt word as a keyword."""
    prompt = F.size(words(F.col("prompt")))
    text = F.coalesce(F.octet_length("prompt"), F.lit(0))
    keyword, keyword_text = prompt, text
    if "keywords" in queries.columns:
        keyword = F.size(words(F.array_join("keywords", " ")))
        keyword_text = F.coalesce(F.octet_length(F.array_join("keywords", " ")), F.lit(0))
    # The artist text stands in a filter row twice, whole and in words.
    artist = F.coalesce(F.octet_length("artist"), F.lit(0)) if "artist" in queries.columns else F.lit(0)
    own_page = F.coalesce("size", F.lit(page)) if "size" in queries.columns else F.lit(page)
    size = queries.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(prompt + keyword), F.lit(0)).alias("words"),
        F.coalesce(F.max(own_page), F.lit(page)).alias("page"),
        F.coalesce(F.sum(3 * artist + 2 * ROW_BYTES), F.lit(0)).alias("filter_bytes"),
        F.coalesce(F.sum(text + keyword_text + ROW_BYTES * (prompt + keyword)), F.lit(0)).alias("word_bytes"),
    ).first()
    asked = queries.select(F.explode(words(F.col("prompt"))).alias("word")).distinct()
    keys = F.size(search_keys(F.col("word")))
    # A key is no longer than its word.
    row = F.octet_length("word") * 2 + ROW_BYTES
    found = asked.agg(F.coalesce(F.sum(keys), F.lit(0)).alias("n"), F.coalesce(F.sum(keys * row), F.lit(0)).alias("bytes")).first()
    return BatchSize(
        size["n"], size["words"], found["n"], size["page"], size["filter_bytes"], size["word_bytes"], found["bytes"]
    )


def small(df: DataFrame, is_small: bool) -> DataFrame:
    return F.broadcast(df) if is_small else df


def keyword_words(queries: DataFrame) -> DataFrame:
    """(query_id, word, n) of the cleaned keywords joined by blanks."""
    text = F.array_join(clean_keywords(F.col("keywords")), " ")
    return _counted(queries, text)


def prompt_words(queries: DataFrame) -> DataFrame:
    return _counted(queries, F.col("prompt"))


def _counted(queries: DataFrame, text: Column) -> DataFrame:
    rows = queries.select("query_id", F.explode(words(text)).alias("word"))
    return rows.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"))


def boost() -> Column:
    value = F.lit(0.0)
    for field, weight in FIELD_BOOSTS.items():
        value = F.when(F.col("field") == field, F.lit(weight)).otherwise(value)
    return value


def _with_idf(df: DataFrame, fields: DataFrame) -> DataFrame:
    joined = df.join(F.broadcast(fields.select("field", "n_docs")), "field")
    return joined.withColumn("idf", idf(F.col("n_docs"), F.col("df")))


def _of_words(query_words: DataFrame, facts: DataFrame, on: str, batch: BatchSize) -> DataFrame:
    """Facts about words for every query that uses them; common words are split."""
    if batch.small_words:
        return facts.join(F.broadcast(query_words), on)
    return join_many_to_one(query_words, facts, [on], ["query_id"], "inner")


def keyword_weights(index: Index, query_words: DataFrame, batch: BatchSize) -> DataFrame:
    """(query_id, field, term, weight) for exact words."""
    met = _of_words(query_words.withColumnRenamed("word", "term"), index.terms, "term", batch)
    weight = (boost() * F.col("n") * F.col("idf")).alias("weight")
    return _with_idf(met, index.fields).select("query_id", "field", "term", weight)


def expand_words(
    index: Index, asked: DataFrame, batch: BatchSize, most: int | None = MAX_EXPANSIONS
) -> DataFrame:
    """(word, field, term, dist, closeness, df): indexed words near each search word.

    Search words are turned into keys and meet the stored keys of the indexed words, which any near
    pair must share. The keys of the index stay where they are, unless the search words have too many
    keys to be sent to them. A pair is measured once, for all
    fields; a word of many search words is met by whatever number of them. At most `most`
    words are kept per field, the closest first (None: all); all count with the document frequency
    of the most frequent one.
    """
    wanted = asked.select("word").distinct().withColumn("key", F.explode(key_numbers(search_keys(F.col("word")))))
    held = index.keys.select("term", F.explode("keys").alias("key"))
    met = held.join(small(wanted, batch.small_keys), "key").select("word", "term").distinct()
    # As an array of at most one, so that each pair is measured once, after duplicates are gone.
    measured = F.array(osa_within(F.col("word"), F.col("term"), allowed_edits(F.col("word"))))
    near = met.withColumn("dist", F.explode(F.filter(measured, lambda d: d.isNotNull())))
    near = near.join(index.terms.select("field", "term", "df"), "term")
    shorter = F.least(F.char_length("word"), F.char_length("term"))
    near = near.withColumn("closeness", 1 - F.col("dist") / shorter)
    if most is not None:
        closest = Window.partitionBy("word", "field").orderBy(F.desc("closeness"), "term")
        near = near.withColumn("__rank", F.row_number().over(closest)).filter(F.col("__rank") <= most).drop("__rank")
    together = Window.partitionBy("word", "field")
    return near.withColumn("df", F.max("df").over(together))


def prompt_weights(
    index: Index, query_words: DataFrame, batch: BatchSize, most: int | None = MAX_EXPANSIONS
) -> DataFrame:
    """(query_id, field, term, weight) for words and their near spellings."""
    met = _of_words(query_words, expand_words(index, query_words, batch, most), "word", batch)
    weight = boost() * F.col("n") * F.col("closeness") * F.col("idf")
    rows = _with_idf(met, index.fields).select("query_id", "field", "term", weight.alias("weight"))
    return rows.groupBy("query_id", "field", "term").agg(F.sum("weight").alias("weight"))


def score_postings(index: Index, weights: DataFrame) -> DataFrame:
    """(query_id, song_id, keyword, prompt): summed relevance per clause.

    weights hold (query_id, field, term, keyword, prompt); they are written once and counted.
    If they name few blocks of the stored lists, only these are read. If they are few, the postings are
    read once, bucket by bucket, and summed in place: a bucket holds whole songs. Else both sides are shuffled by word, with the postings of a word
    spread over several tasks where it has many pairs of postings and queries.
    """
    held = index.postings.select("song_id", "field", "term", "impact")
    weights = cut(weights)
    size = weights.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term") + ROW_BYTES).alias("bytes")).first()
    few = size["n"] <= SMALL_ROWS and (size["bytes"] or 0) <= SMALL_BYTES
    listed = asked_postings(index, weights) if few else None
    if listed is not None:
        met = listed.join(F.broadcast(weights), ["field", "term"])
    elif few:
        met = held.join(F.broadcast(weights), ["field", "term"])
    else:
        on = ["field", "term"]
        asked = weights.groupBy(*on).agg(F.count(F.lit(1)).alias("asked"))
        pairs = F.col("df") * F.col("asked")
        hot = index.terms.join(asked, on).filter(pairs > PAIRS_PER_TASK)
        hot = hot.select(*on, F.least(F.ceil(pairs / PAIRS_PER_TASK), F.col("df")).cast("int").alias(PARTS))
        spread = spread_hot(held, hot, on, [F.col("song_id")]).drop(PARTS)
        met = spread.join(copy_hot(weights, hot, on).drop(PARTS), [*on, SALT])
    return met.groupBy("query_id", "song_id").agg(
        F.sum(F.col("impact") * F.col("keyword")).alias("keyword"),
        F.sum(F.col("impact") * F.col("prompt")).alias("prompt"),
    )


def read_keywords(answer: Column) -> Column:
    """The keywords in the answer of a model, {"keywords": [...]}; of any other text an empty list."""
    listed = F.from_json(answer, "keywords array<string>")["keywords"]
    return clean_keywords(listed)


def with_keywords(queries: DataFrame, provider: Provider, batch_size: int = PROMPTS_PER_CALL) -> DataFrame:
    """Fill the keywords column of queries by a model, asked once for every distinct prompt.

    provider turns a list of prompts into as many answers, each read by read_keywords. A call that
    fails, or gives another number of answers, leaves its prompts without keywords.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame["prompt"].iloc[start : start + batch_size].tolist()
                answers: list[str | None] = [None] * len(part)
                try:
                    given = list(provider(part))
                    answers = given if len(given) == len(part) else answers
                except Exception:  # the hook is foreign code
                    pass
                yield pd.DataFrame({"prompt": part, "answer": answers})

    prompts = queries.select("prompt").filter(F.col("prompt").isNotNull()).distinct()
    read = prompts.mapInPandas(run, "prompt string, answer string")
    read = read.select("prompt", read_keywords(F.col("answer")).alias("keywords"))
    return join_many_to_one(queries.drop("keywords"), read, ["prompt"], ["query_id"])


def suggest_keywords(
    index: Index, queries: DataFrame, field: str = "lyrics", most: int | None = None
) -> DataFrame:
    """Without a model: the prompt words that are indexed, by tf-idf.

    Gives (query_id, place, word, weight), at most `most` words per query (None: all).
    """
    asked = prompt_words(queries).withColumnRenamed("word", "term")
    met = _of_words(asked, index.terms.filter(F.col("field") == field), "term", batch_size(queries))
    weight = F.round(F.col("n") * F.col("idf"), 6).alias("weight")
    rows = _with_idf(met, index.fields).select("query_id", F.col("term").alias("word"), weight)
    best = Window.partitionBy("query_id").orderBy(F.desc("weight"), "word")
    placed = rows.withColumn("place", F.row_number().over(best))
    return placed if most is None else placed.filter(F.col("place") <= most)


def with_suggested_keywords(index: Index, queries: DataFrame, most: int | None = None) -> DataFrame:
    """Fill the keywords column of queries."""
    picked = suggest_keywords(index, queries, most=most)
    ordered = F.array_sort(F.collect_list(F.struct("place", "word")))
    lists = picked.groupBy("query_id").agg(F.transform(ordered, lambda p: p["word"]).alias("keywords"))
    return queries.drop("keywords").join(lists, "query_id", "left")
