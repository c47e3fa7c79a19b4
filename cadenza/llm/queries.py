"""Registered queries of this subpackage and the oracle SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cadenza.llm import (
    alignment, bpe, kneser_ney, lexical_search, line_dedup, mixing, multiset_hash, packing, quality_rules, simhash, toxicity, url_rules,
    warc,
)
from cadenza.llm.common import table


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.learn_labels(table(spark, sf_dir, "labels")))
    judged = toxicity.scored(docs.select("doc_id", "text"), model)
    return judged.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op2_multiset_hash(spark, sf_dir):
    return multiset_hash.fingerprinted(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    cut_docs = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cut_docs.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op4_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP4_SQL = r"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, lang, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i+4]) AS n FROM places),
starts AS (
  SELECT doc_id, i, lag(i, 1, -5) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows WHERE n > 1),
repeats AS (SELECT doc_id, sum(least(5, i - before)) AS n FROM starts GROUP BY doc_id),
left_1 AS (SELECT *, regexp_replace(text, '\p{Ll}+', '', 'g') AS t1 FROM split),
left_2 AS (SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]+', '', 'g') AS t2 FROM left_1),
left_3 AS (SELECT *, regexp_replace(t2, '[.,;:!?]+', '', 'g') AS t3 FROM left_2),
left_4 AS (SELECT *, regexp_replace(t3, '[\p{Lu}\p{Lt}]+', '', 'g') AS t4 FROM left_3),
left_5 AS (SELECT *, regexp_replace(t4, '[\p{Lm}\p{Lo}\p{M}]+', '', 'g') AS t5 FROM left_4),
left_6 AS (SELECT *, regexp_replace(t5, '\p{N}+', '', 'g') AS t6 FROM left_5),
counted AS (
  SELECT l.doc_id, lang, len(words) AS n_words, length(text) - (length(t1) - length(t2)) AS word_chars,
         length(t6) - length(regexp_replace(t6, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         [length(text) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4),
          length(t4) - length(t5), length(t5) - length(t6), length(t6)] AS classes
  FROM left_6 l LEFT JOIN repeats r USING (doc_id)),
class_bins AS (SELECT doc_id, lang, unnest(classes) AS n, unnest(range(7)) AS bin FROM counted),
class_refs AS (SELECT lang, bin, sum(n) AS s FROM class_bins GROUP BY ALL),
class_shares AS (
  SELECT b.doc_id, b.n / sum(b.n) OVER (PARTITION BY b.doc_id) AS p, r.s / sum(r.s) OVER (PARTITION BY b.doc_id) AS q
  FROM class_bins b JOIN class_refs r ON r.lang IS NOT DISTINCT FROM b.lang AND r.bin = b.bin),
class_js AS (
  SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                 + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d
  FROM class_shares GROUP BY doc_id),
words AS (
  SELECT doc_id, lang, unnest(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS word
  FROM docs),
word_counts AS (SELECT lang, word, count(*) AS n FROM words GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank, sum(n) OVER (PARTITION BY lang) AS total
  FROM word_counts),
common AS (SELECT lang, word, n / total AS share FROM ranked WHERE rank <= 50),
rest AS (SELECT lang, 1 - sum(share) AS share FROM common GROUP BY lang),
word_bins AS (
  SELECT w.doc_id, w.lang, c.word, c.share, count(*) AS n
  FROM words w LEFT JOIN common c ON c.lang IS NOT DISTINCT FROM w.lang AND c.word = w.word GROUP BY ALL),
word_shares AS (
  SELECT b.doc_id, b.n / sum(b.n) OVER (PARTITION BY b.doc_id) AS p, coalesce(b.share, r.share) AS q
  FROM word_bins b JOIN rest r ON r.lang IS NOT DISTINCT FROM b.lang),
word_js AS (
  SELECT doc_id, sqrt(greatest((sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)
                                + greatest(1 - sum(q), 0)) / 2, 0)) AS d
  FROM word_shares GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT coalesce(n_words >= 50 AND c.d > 0.30, false) AND NOT coalesce(n_words >= 100 AND w.d > 0.42, false) AS kept
FROM counted LEFT JOIN class_js c USING (doc_id) LEFT JOIN word_js w USING (doc_id)
"""


def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trips(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


# Verdict, host and path of the given rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_url_rules(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    named = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    return url_rules.judge(table(spark, sf_dir, "pages"), named, URL_RULES)


def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


OP8_SQL = """
WITH sized AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM sized),
kept AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM hashed
  WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
       CASE WHEN k.keeper IS NULL OR k.keeper = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.keeper <> h.page_id THEN k.keeper END AS refers_to
FROM hashed h LEFT JOIN kept k USING (payload_digest, payload_bytes)
"""


def trusted_ids(spark, sf_dir):
    """Documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")


def op9_kneser_ney(spark, sf_dir):
    judged = kneser_ney.judge(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return judged.drop("text_hash")


def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op11_alignment(spark, sf_dir):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned(table(spark, sf_dir, "documents"), a, b)


def op12_lexical_search(spark, sf_dir):
    return lexical_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM doc_terms WHERE len(terms) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
counted AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, corpus GROUP BY term),
asked AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN counted USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op13_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_multiset_hash": op2_multiset_hash,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_url_rules": op7_url_rules,
    "op8_warc": op8_warc,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_mixing": op13_mixing,
}
ORACLES = {"op3_line_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op8_warc": OP8_SQL, "op12_lexical_search": OP12_SQL}
