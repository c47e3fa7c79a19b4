"""The search index: documents, postings and corpus statistics as plain tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.distance import vocabulary_keys
from cadenza.functions.text import words
from cadenza.operators.pivots import Pivots

# Searched fields with their boosts, and the constants of the relevance formula.
FIELD_BOOSTS = {"song_name": 3.0, "name_artists": 2.0, "lyrics": 1.0}
K1 = 1.2
B = 0.75


@dataclass(frozen=True)
class Index:
    """documents: one row per song. postings: one row per song, field and word.
    terms: document frequency per field and word. fields: size statistics per field.
    keys: what each different word is found by when it is misspelt, one row per word. lists: the
    postings once more, by word, only in a stored index, where terms also have the largest impact of their list.
    groups: the vectors once more, around pivots, only in a stored index."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    keys: DataFrame
    lists: DataFrame | None = None
    groups: Pivots | None = None


def field_words(documents: DataFrame) -> DataFrame:
    """(song_id, field, words) for every searched field that has at least one word."""
    fields = F.array(
        *[F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("words")) for f in FIELD_BOOSTS]
    )
    return documents.select("song_id", F.inline(fields)).filter(F.size("words") > 0)


def term_counts(documents: DataFrame) -> DataFrame:
    """(song_id, field, dl, term, tf). Documents spread by song_id need no shuffle here."""
    rows = field_words(documents).select(
        "song_id", "field", F.size("words").alias("dl"), F.explode("words").alias("term")
    )
    return rows.groupBy("song_id", "field", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def field_stats(documents: DataFrame) -> DataFrame:
    sizes = field_words(documents).select("field", F.size("words").alias("dl"))
    return sizes.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("dl").alias("n_words"),
        (F.sum("dl") / F.count(F.lit(1))).alias("avg_dl"),
    )


def counted_stats(counts: DataFrame) -> DataFrame:
    """field_stats from the term counts of the same documents.

    The counts of a document add up to its length, those of several rows of one song and length to a multiple of it.
    """
    sizes = counts.groupBy("song_id", "field", "dl").agg(F.sum("tf").alias("n"))
    sizes = sizes.select("field", "n", F.expr("n div dl").alias("docs"))
    return sizes.groupBy("field").agg(
        F.sum("docs").alias("n_docs"),
        F.sum("n").alias("n_words"),
        (F.sum("n") / F.sum("docs")).alias("avg_dl"),
    )


def term_stats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def list_stats(postings: DataFrame) -> DataFrame:
    """term_stats with the largest impact of each word."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("most"))


def key_numbers(keys: Column) -> Column:
    """Lookup keys as 32-bit numbers. Different keys of one number lead to words that are no nearer
    than allowed; their distance is computed like that of any other."""
    return F.array_distinct(F.transform(keys, lambda key: F.hash(key)))


def word_keys(terms: DataFrame) -> DataFrame:
    """(term, keys): the numbers of the lookup keys of every different word.

    A word has some 50 keys, so they stay with it: what is moved is the word alone.
    """
    return terms.select("term").distinct().select("term", key_numbers(vocabulary_keys(F.col("term"))).alias("keys"))


def impact(tf: Column, dl: Column, avg_dl: Column) -> Column:
    """The part of the relevance weight that depends on the document alone."""
    return (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl / avg_dl))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def postings(counts: DataFrame, fields: DataFrame) -> DataFrame:
    """Term counts with their impact. There are only as many field rows as searched fields."""
    sized = counts.join(F.broadcast(fields.select("field", "avg_dl")), "field")
    weight = impact(F.col("tf"), F.col("dl"), F.col("avg_dl")).alias("impact")
    return sized.select("song_id", "field", "term", "tf", "dl", weight)


def build_index(documents: DataFrame, counts: DataFrame | None = None, fields: DataFrame | None = None) -> Index:
    """The index as a lazy plan. Use sources.index_store to build it once and search often.

    counts and fields are those of the same documents where they are already stored (index_store.save_counts);
    without them texts are cut into words again for every part that is asked for.
    """
    counts = term_counts(documents) if counts is None else counts
    fields = field_stats(documents) if fields is None else fields
    terms = term_stats(counts)
    return Index(documents, postings(counts, fields), terms, fields, word_keys(terms))
