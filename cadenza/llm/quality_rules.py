"""Quality rules on whole texts, with built-in functions only.

Base rules count words, symbols, repeated lines and repeated five-word windows inside each row. The
method's rule compares a document with its language: the Jensen-Shannon distance between histograms
of character classes, and between histograms of common words, of the document and of all documents
of its language. Both references are counted over the whole corpus. Documents that are too short for
a histogram to mean anything are not judged by it.

Defined results:
- A missing or empty text has no words; it fails the base rules.
- A missing language is a language of its own. A language without words has no reference, and its
  documents have no distance.
- Rows that share a doc_id are judged one by one, by their own text. An empty table gives an empty
  result; other columns are ignored.
- Five-word windows are compared by a 64-bit hash within a document. The words of one text are one
  array in its row, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import join_small, row_of
from cadenza.session import cut

# What separates words, what counts as a symbol, and the classes of characters, in the
# order in which they are taken out of a text. What is left is the class "other".
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
CLASSES = {
    "lower": r"\p{Ll}+",
    "blank": BLANKS,
    "stop": r"[.,;:!?]+",
    "upper": r"[\p{Lu}\p{Lt}]+",
    "letter": r"[\p{Lm}\p{Lo}\p{M}]+",
    "digit": r"\p{N}+",
}
BINS = [*CLASSES, "other"]

# w: words; h: hashes of their windows; t: (hash, place) in order; the sum is over the places of
# windows that occur twice, each counting the words that the window before it has not covered. The
# lists of one element bind a value once per row.
REPEATED_WORDS = """
transform(array(words), w -> CASE WHEN size(w) < 6 THEN 0L ELSE
  transform(array(transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))),
    h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
      transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))),
        t -> aggregate(
          sort_array(transform(filter(t, (x, i) ->
            (i > 0 AND t[greatest(i - 1, 0)].h = x.h) OR (i + 1 < size(t) AND t[least(i + 1, size(t) - 1)].h = x.h)),
            x -> x.i)),
          named_struct('n', 0L, 'last', -5),
          (a, p) -> named_struct('n', a.n + least(5, p - a.last), 'last', p),
          a -> a.n))[0] END)[0] END)[0]
"""
REPEATED_LINES = """
transform(array(filter(split(text, '\\n', -1), x -> btrim(x, ' \\t\\n\\u000B\\f\\r') != '')),
  l -> size(l) - size(array_distinct(l)))[0]
"""


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS, -1), lambda w: w != "")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: its counts, the base verdict, and how many characters of each class."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*row_of(id_col, text_col), F.col(lang_col).alias("lang"), text.alias("text"))
    rows = rows.withColumn("left_0", F.col("text"))
    for i, (name, pattern) in enumerate(CLASSES.items()):
        rows = rows.withColumn(f"left_{i + 1}", F.regexp_replace(f"left_{i}", pattern, ""))
        rows = rows.withColumn(f"c_{name}", F.char_length(f"left_{i}") - F.char_length(f"left_{i + 1}"))
    rest = F.col(f"left_{len(CLASSES)}")
    rows = rows.withColumn("c_other", F.char_length(rest)).withColumn("words", words_of(F.col("text")))
    counted = rows.select(
        "doc_id", "text_hash", "lang", F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - F.col("c_blank")).cast("long").alias("word_chars"),
        (F.char_length(rest) - F.char_length(F.regexp_replace(rest, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(REPEATED_LINES).cast("long").alias("n_dup_lines"),
        F.expr(REPEATED_WORDS).cast("long").alias("n_repeat_words"),
        *[F.col(f"c_{name}").cast("long").alias(f"c_{name}") for name in BINS],
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _lower_words(docs: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    # What is kept is computed before the words are taken apart, once per row.
    rows = docs.select(*kept, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__text"))
    names = [c for c in rows.columns if c != "__text"]
    return rows.select(*names, F.explode(F.split("__text", BLANKS, -1)).alias("word")).filter(F.col("word") != "")


def common_words(docs: DataFrame, totals: DataFrame, text_col: str, lang_col: str, most: int) -> DataFrame:
    """lang, word, share of the `most` most frequent words of every language, ties by alphabet.

    totals has the number of words (total) of every language. One more row per language, with a
    missing word, has the share of all other words.
    """
    counts = _lower_words(docs, text_col, F.col(lang_col).alias("lang")).groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n")
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= most)
    named = totals.select(F.col("lang").alias("__lang"), "total")
    met = cut(top).join(named, F.col("lang").eqNullSafe(F.col("__lang")))
    shares = met.select("lang", "word", (F.col("n") / F.col("total")).alias("share"))
    others = shares.groupBy("lang").agg((1 - F.sum("share")).alias("share"))
    return shares.unionByName(others.select("lang", F.lit(None).cast("string").alias("word"), "share"))


def _term(p: Column, q: Column) -> Column:
    """What a bin adds to twice the divergence."""
    own = F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    return own + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)


def _distance(double: Column) -> Column:
    return F.sqrt(F.greatest(double / 2, F.lit(0.0)))


def class_distances(counted: DataFrame) -> DataFrame:
    """counted with class_distance, to the classes of all documents of the language."""
    sums = [F.sum(f"c_{name}").alias(f"s_{name}") for name in BINS]
    references = cut(counted.groupBy("lang").agg(*sums))
    met = join_small(counted, references, ["lang"], ["doc_id", "text_hash"])
    own, all_ = sum(F.col(f"c_{name}") for name in BINS), sum(F.col(f"s_{name}") for name in BINS)
    terms = [_term(F.col(f"c_{name}") / own, F.col(f"s_{name}") / all_) for name in BINS]
    distance = F.when(own > 0, _distance(sum(terms)))
    return met.withColumn("class_distance", distance).drop(*[f"s_{name}" for name in BINS])


def _lang_key(lang: Column) -> Column:
    return F.xxhash64(lang.isNull(), lang)


def word_distances(
    docs: DataFrame, counted: DataFrame, id_col: str, text_col: str, lang_col: str, most: int
) -> DataFrame:
    """doc_id, text_hash, word_distance of every document with words; counted is that of `measures`.

    A word is known by one number, a hash of its language and itself; the other words of a language
    by that of the language.
    """
    totals = counted.groupBy("lang").agg(F.sum("n_words").alias("total"))
    references = common_words(docs, totals, text_col, lang_col, most).withColumn("lang_key", _lang_key(F.col("lang")))
    key = F.when(F.col("word").isNull(), F.col("lang_key")).otherwise(F.xxhash64("lang_key", "word"))
    references = cut(references.select(key.alias("key"), F.col("word").isNull().alias("rest"), "share"))
    common = references.filter(~F.col("rest")).select("key", F.lit(True).alias("common"))
    keyed = docs.withColumn("__lang_key", _lang_key(F.col(lang_col)))
    words = _lower_words(keyed, text_col, *row_of(id_col, text_col), F.col("__lang_key").alias("lang_key"))
    hashed = words.select("doc_id", "text_hash", "lang_key", F.xxhash64("lang_key", "word").alias("key"))
    met = join_small(hashed, common, ["key"], ["doc_id", "text_hash"], missing=False)
    bins = met.groupBy("doc_id", "text_hash", F.when(F.col("common"), F.col("key")).otherwise(F.col("lang_key")).alias("key"))
    counts = bins.agg(F.count(F.lit(1)).alias("n"))
    shares = references.select("key", F.col("share").alias("q"))
    held = join_small(counts, shares, ["key"], ["doc_id", "text_hash"], missing=False).select("doc_id", "text_hash", "n", "q")
    totals = held.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("total"), F.collect_list(F.struct("n", "q")).alias("bins"))
    # Bins of the language that the document lacks add their share.
    present = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["q"])
    terms = F.transform("bins", lambda b: _term(b["n"] / F.col("total"), b["q"]))
    double = F.aggregate(F.array_sort(terms), F.lit(0.0), lambda a, t: a + t) + F.greatest(1 - present, F.lit(0.0))
    return totals.select("doc_id", "text_hash", _distance(double).alias("word_distance"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: int = 50,
    class_limit: float = 0.30,
    class_least: int = 50,
    word_limit: float = 0.42,
    word_least: int = 100,
) -> DataFrame:
    """Counts, base_failed, class_distance, word_distance and kept of every document.

    A document of at least class_least words fails if its character classes are further than
    class_limit from its language, one of at least word_least words if its words are further than
    word_limit. The limits lie above what documents labelled good reach, by a fifth.
    """
    counted = cut(measures(docs, id_col, text_col, lang_col))
    by_class = class_distances(counted)
    by_word = word_distances(docs, counted, id_col, text_col, lang_col, common)
    by_word = by_word.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "word_distance")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    met = by_class.join(by_word, same, "left").drop("__id", "__hash")
    odd = ((F.col("n_words") >= class_least) & (F.col("class_distance") > class_limit)) | (
        (F.col("n_words") >= word_least) & (F.col("word_distance") > word_limit)
    )
    return met.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
