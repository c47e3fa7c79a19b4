"""Removal of lines that many documents share, with built-in functions only.

Line hashes are dealt by range, so that one very common line spans several partitions; inside them
the largest document of a line comes first. Each partition passes on one row per line, and what is
known of a line is joined back to its places. A document gets its result as a compressed bitmap:
64 lines to a word, words without a dropped line left out. No text takes part before that.

Defined results:
- A missing or empty text is one empty line.
- Rows that share a doc_id count as one document; each is cut by its own lines. A missing doc_id is
  one document, smaller than all others.
- Lines are compared by two 64-bit hashes of their key. The lines of one text are one array in its
  row, whatever its length.
- An empty table gives an empty result. Further columns are ignored by `keep_bitmaps` and kept by
  `drop_repeated_lines`, except those that carry the names of its results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import BLANKS, row_of, with_columns_replaced
from cadenza.session import cut

# Letters that count as equal in both cases.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

WORD_BITS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_places(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 of every line whose key is long enough."""
    # The hash of a text is computed before its lines are taken apart, once per row.
    rows = docs.select(*row_of(id_col, text_col), F.col(text_col).alias("text"))
    lines = rows.select("doc_id", "text_hash", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    long = keyed.filter(F.char_length("key") >= least_chars)
    return long.select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def repeated_lines(places: DataFrame, least_docs: int) -> DataFrame:
    """h1, h2, keeper: the first holder, in descending order, of every line in enough documents."""
    dealt = places.select("h1", "h2", "doc_id").repartitionByRange("h1", "h2", F.col("doc_id").desc())
    held = dealt.sortWithinPartitions("h1", "h2", F.col("doc_id").desc()).distinct()
    counted = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n_docs") >= least_docs).select("h1", "h2", "keeper")


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 3, least_chars: int = 20
) -> DataFrame:
    """doc_id, text_hash, keep for every row that loses lines.

    keep is a list of (word, bits), by word; bit i of word w is set if line 64 * w + i stays.
    Words of which all lines stay are left out.
    """
    # Both sides of the join come from written tables, so that adaptive execution can split the
    # places of a very common line over several tasks, and texts are cut into lines once.
    places = cut(line_places(docs, id_col, text_col, least_chars))
    met = places.join(cut(repeated_lines(places, least_docs)), ["h1", "h2"])
    dropped = met.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bits = F.expr(f"bit_or(shiftleft(1L, pos % {WORD_BITS}))")
    words = dropped.groupBy("doc_id", "text_hash", F.expr(f"cast(pos div {WORD_BITS} as int)").alias("word")).agg(
        F.bitwise_not(bits).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _dense(keep: Column) -> Column:
    """One word for every 64 lines, up to the last that is stored."""
    runs = F.transform(
        keep,
        lambda entry, i: F.concat(
            F.array_repeat(
                F.lit(-1).cast("long"),
                F.when(i == 0, entry["word"]).otherwise(entry["word"] - F.element_at(keep, i)["word"] - 1),
            ),
            F.array(entry["bits"]),
        ),
    )
    return F.flatten(runs)


def _kept_lines(lines: Column, keep: Column) -> Column:
    # The one-element list binds the dense words once per row, not once per line.
    return F.transform(
        F.array(_dense(keep)),
        lambda words: F.filter(
            lines,
            lambda line, i: F.coalesce(
                F.getbit(F.get(words, F.floor(i / WORD_BITS).cast("int")), i % WORD_BITS), F.lit(1)
            )
            == 1,
        ),
    )[0]


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 3, least_chars: int = 20
) -> DataFrame:
    """docs with kept_text, n_lines (before) and n_dropped."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, least_docs, least_chars)
    bitmaps = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("keep").alias("__keep"))
    row_id, row_hash = row_of(id_col, text_col)
    marked = docs.withColumn("__row_hash", row_hash)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row_hash") == F.col("__hash"))
    joined = marked.join(bitmaps, same, "left").drop("__id", "__hash", "__row_hash")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.when(F.col("__keep").isNull(), text).otherwise(
        F.array_join(_kept_lines(lines_of(F.col(text_col)), F.col("__keep")), "\n")
    )
    gone = F.aggregate(
        F.coalesce(F.col("__keep"), F.array().cast("array<struct<word:int,bits:bigint>>")),
        F.lit(0).cast("long"),
        lambda total, entry: total + WORD_BITS - F.bit_count(entry["bits"]),
    )
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return with_columns_replaced(
        joined, kept_text=kept, n_lines=n_lines.cast("long"), n_dropped=gone.cast("long")
    ).drop("__keep")
