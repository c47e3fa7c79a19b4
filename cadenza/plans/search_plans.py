"""Registered search queries, with their oracle texts."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions.text import clean_keywords
from cadenza.operators import enrich as en
from cadenza.operators import filters as fl
from cadenza.operators import hybrid as hy
from cadenza.operators import index as ix
from cadenza.operators import knn, lexical as lx, pivots as pv, term_lists as tl
from cadenza.plans import inputs
from cadenza.plans.catalog_plans import CATALOG_VIEWS, INDEX_CTE, WORDS, words_by_character
from cadenza.session import cut, new_path
from cadenza.sources.catalog_views import base_table, view, with_views
from cadenza.sources.index_store import buckets_for, save_counts


def knn_top(spark, sf_dir):
    given = inputs.search_inputs(spark, sf_dir)
    return knn.nearest(given.index.documents, given.queries)


def knn_pruned(spark, sf_dir):
    """The same from the grouped vectors, of which only those that can be near are visited."""
    given = inputs.search_inputs(spark, sf_dir)
    return pv.nearest(given.index.groups, given.queries)


def keywords_clean(spark, sf_dir):
    parts = F.split("text", "[.,]")
    rows = base_table(spark, sf_dir, "documents")
    cleaned = clean_keywords(parts)
    return rows.select(
        "doc_id", F.size(cleaned).cast("long").alias("n"), F.array_join(cleaned, " ").alias("keywords")
    )


def keywords_tfidf(spark, sf_dir):
    given = inputs.search_inputs(spark, sf_dir)
    rows = lx.suggest_keywords(given.index, given.queries, most=inputs.KEYWORDS)
    return rows.select("query_id", F.col("place").cast("long").alias("place"), "word", "weight")


def _best_by_words(given, weights):
    """The best hits of one clause alone."""
    weights = weights.withColumnRenamed("weight", "keyword").withColumn("prompt", F.lit(0.0))
    return _ranked(lx.score_postings(given.index, weights))


def _ranked(scores):
    rounded = scores.select("query_id", "song_id", F.round("keyword", 6).alias("score")).filter("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "song_id")
    ranked = rounded.withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.filter(F.col("rank") <= lx.PAGE_SIZE)


def bm25_keywords(spark, sf_dir):
    given = inputs.search_inputs(spark, sf_dir)
    asked = lx.keyword_words(given.queries)
    return _best_by_words(given, lx.keyword_weights(given.index, asked, lx.batch_size(given.queries)))


def bm25_pruned(spark, sf_dir):
    """The same from the stored lists, of which only what can reach the page is read."""
    given = inputs.search_inputs(spark, sf_dir)
    weights = lx.keyword_weights(given.index, lx.keyword_words(given.queries), lx.batch_size(given.queries))
    weights = weights.select("query_id", "field", "term", F.col("weight").alias("keyword"), F.lit(0.0).alias("prompt"))
    sums = weights.groupBy("query_id", "field", "term").agg(F.sum("keyword").alias("keyword"), F.sum("prompt").alias("prompt"))
    scores = tl.best_songs(given.index, sums, lx.PAGE_SIZE)
    return _ranked(lx.score_postings(given.index, sums) if scores is None else scores)


def search_single(spark, sf_dir):
    """One request, the first of the batch, as the service gets them one by one."""
    given = inputs.search_inputs(spark, sf_dir)
    first = given.queries.agg(F.min("query_id").alias("first"))
    one = given.queries.join(F.broadcast(first), F.col("query_id") == F.col("first")).drop("first")
    return _shown(hy.search(given.index, cut(one), use_filters=False))


def bm25_fuzzy(spark, sf_dir):
    given = inputs.search_inputs(spark, sf_dir)
    asked = lx.prompt_words(given.queries)
    return _best_by_words(given, lx.prompt_weights(given.index, asked, lx.batch_size(given.queries)))


def bm25_scripts(spark, sf_dir):
    """Keyword search over lyrics that mix Latin letters with Japanese or Thai."""
    nothing = F.lit(None).cast("string")
    lyrics = view(spark, sf_dir, "lyrics_scripts").select("song_id", nothing.alias("song_name"), nothing.alias("name_artists"), "lyrics")
    # Words of whole texts are costly to find, so they are found and counted once, for all parts of the index.
    path = new_path(spark, "scripts")
    buckets = buckets_for(spark, base_table(spark, sf_dir, "documents").count())
    counts, fields = save_counts(lyrics, "cadenza_" + path.rsplit("-", 1)[1], path, buckets)
    index = ix.build_index(lyrics, counts, fields)
    queries = view(spark, sf_dir, "prompts_scripts").withColumn("keywords", F.array("prompt"))
    weights = lx.keyword_weights(index, lx.keyword_words(queries), lx.batch_size(queries))
    return _best_by_words(inputs.SearchInputs(index, queries), weights)


def keywords_all(spark, sf_dir):
    """Every indexed prompt word as a keyword."""
    given = inputs.search_inputs(spark, sf_dir)
    rows = lx.suggest_keywords(given.index, given.queries)
    return rows.select("query_id", F.col("place").cast("long").alias("place"), "word", "weight")


def _answers(prompts):
    """What a model might say: the first two words as JSON, or plain text for short prompts."""
    return [json.dumps({"keywords": [*p.split()[:2], " "]}) if len(p) > 300 else f"I suggest {p[:9]}" for p in prompts]


def keywords_answers(spark, sf_dir):
    rows = lx.with_keywords(view(spark, sf_dir, "queries"), _answers)
    return rows.select("query_id", F.size("keywords").cast("long").alias("n"), F.array_join("keywords", " ").alias("keywords"))


def _expanded(spark, sf_dir, most):
    given = inputs.search_inputs(spark, sf_dir)
    asked = lx.prompt_words(given.queries)
    rows = lx.expand_words(given.index, asked, lx.batch_size(given.queries), most)
    return rows.select(
        "word", "field", "term", F.col("dist").cast("long").alias("dist"), F.round("closeness", 6).alias("closeness"), "df"
    )


def fuzzy_expand(spark, sf_dir):
    return _expanded(spark, sf_dir, lx.MAX_EXPANSIONS)


def fuzzy_expand_all(spark, sf_dir):
    """Near spellings without a limit per word."""
    return _expanded(spark, sf_dir, None)


def _shown(hits):
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "song_id", "score",
        F.array_join("matched_queries", "+").alias("matched"),
    )


def search_hybrid(spark, sf_dir):
    given = inputs.search_inputs(spark, sf_dir)
    return _shown(hy.search(given.index, given.queries, use_filters=False))


def search_filtered(spark, sf_dir):
    given = inputs.search_inputs(spark, sf_dir)
    return _shown(hy.search(given.index, given.queries))


def filter_queries(spark, sf_dir):
    given = inputs.search_inputs(spark, sf_dir)
    few = lx.batch_size(given.queries).few_queries
    pairs = fl.passing_documents(given.index.documents, given.queries, few)
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_passing"), F.min("song_id").alias("first_song"))


def search_enriched(spark, sf_dir):
    given = inputs.search_inputs(spark, sf_dir)
    hits = cut(hy.search(given.index, given.queries))
    rows = en.enrich(
        hits,
        given.index.documents,
        view(spark, sf_dir, "tracks"),
        view(spark, sf_dir, "song_links"),
        view(spark, sf_dir, "acoustic_features"),
    )
    return rows.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "song_id", "title", "artist", "score",
        F.array_join("matched_queries", "+").alias("matched"), "spotify_url", "youtube_music_url",
        "popularity", "release_date", "energy", "lyrics", "reason",
    )


QUERIES = {
    f.__name__: f
    for f in (
        knn_top, knn_pruned, keywords_clean, keywords_tfidf, keywords_all, keywords_answers, bm25_keywords, fuzzy_expand,
        fuzzy_expand_all, bm25_fuzzy, bm25_scripts, bm25_pruned,
        search_hybrid, search_single, search_filtered, filter_queries, search_enriched,
    )
}

SEARCH_VIEWS = CATALOG_VIEWS + " queries"

# Byte-wise distances of the oracle count characters once every letter is a single byte.
_one_byte = "translate({0}, 'éóèñçêüöäíß', 'ABCDEFGHIJK')"

BASE_CTE = f"""{INDEX_CTE},
  prompt_words AS (
    SELECT query_id, word, count(*) AS n
    FROM (SELECT query_id, unnest({WORDS.format('prompt')}) AS word FROM queries) GROUP BY ALL),
  term_idf AS (SELECT t.field, t.term, t.df, f.n_docs,
                      ln(1 + (f.n_docs - t.df + 0.5e0) / (t.df + 0.5e0)) AS idf
               FROM terms t JOIN fields f USING (field)),
  boosts AS (SELECT * FROM (VALUES ('song_name', 3e0), ('name_artists', 2e0), ('lyrics', 1e0)) b(field, boost)),
  placed AS (
    SELECT p.query_id, p.word, round(p.n * t.idf, 6) AS weight,
           row_number() OVER (PARTITION BY p.query_id ORDER BY round(p.n * t.idf, 6) DESC, p.word) AS place
    FROM prompt_words p JOIN term_idf t ON t.term = p.word AND t.field = 'lyrics'),
  picked AS (SELECT * FROM placed WHERE place <= {inputs.KEYWORDS})"""

KEYWORD_CTE = f"""{BASE_CTE},
  keyword_weights AS (SELECT k.query_id, t.field, t.term, b.boost * t.idf AS weight
                      FROM picked k JOIN term_idf t ON t.term = k.word JOIN boosts b USING (field)),
  keyword_scores AS (SELECT w.query_id, p.song_id, sum(w.weight * p.impact) AS keyword
                     FROM keyword_weights w JOIN postings p USING (field, term) GROUP BY ALL)"""

FUZZY_CTE = f"""{KEYWORD_CTE},
  asked AS (SELECT word, {_one_byte.format('word')} AS a, length(word) AS n,
                   CASE WHEN length(word) <= 2 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END AS k
            FROM (SELECT DISTINCT word FROM prompt_words)),
  sought AS (SELECT *, unnest(range(n - k, n + k + 1)) AS m FROM asked),
  vocabulary AS (SELECT term, {_one_byte.format('term')} AS b, CAST(length(term) AS BIGINT) AS m
                 FROM (SELECT DISTINCT term FROM terms)),
  pairs AS (SELECT word, term, a, b, k, damerau_levenshtein(a, b) AS d
            FROM sought JOIN vocabulary USING (m) WHERE damerau_levenshtein(a, b) <= k),
  near AS (
    SELECT word, term, d FROM pairs
    WHERE d < 2 OR levenshtein(a, b) <> 3
      OR len(list_filter(range(1, length(a)), lambda i:
           (substr(a, i, 1) = substr(b, i + 1, 1) AND substr(a, i + 1, 1) = substr(b, i, 1)
            AND left(a, i - 1) = left(b, i - 1) AND damerau_levenshtein(substr(a, i + 2), substr(b, i + 2)) <= 1)
           OR (i + length(b) - length(a) >= 1
            AND substr(a, i, 1) = substr(b, i + length(b) - length(a) + 1, 1)
            AND substr(a, i + 1, 1) = substr(b, i + length(b) - length(a), 1)
            AND substr(a, i + 2) = substr(b, i + length(b) - length(a) + 2)
            AND damerau_levenshtein(left(a, i - 1), left(b, i + length(b) - length(a) - 1)) <= 1))) > 0),
  expanded AS (
    SELECT word, field, term, d AS dist, closeness, max(df) OVER (PARTITION BY word, field) AS df
    FROM (SELECT n.word, t.field, n.term, n.d, t.df,
                 1 - n.d / CAST(least(length(n.word), length(n.term)) AS DOUBLE) AS closeness,
                 row_number() OVER (PARTITION BY n.word, t.field
                   ORDER BY 1 - n.d / CAST(least(length(n.word), length(n.term)) AS DOUBLE) DESC, n.term) AS r
          FROM near n JOIN terms t USING (term)) WHERE r <= 50),
  prompt_weights AS (
    SELECT p.query_id, x.field, x.term,
           sum(b.boost * p.n * x.closeness * ln(1 + (f.n_docs - x.df + 0.5e0) / (x.df + 0.5e0))) AS weight
    FROM expanded x JOIN prompt_words p USING (word) JOIN fields f USING (field) JOIN boosts b USING (field)
    GROUP BY ALL),
  prompt_scores AS (SELECT w.query_id, p.song_id, sum(w.weight * p.impact) AS prompt
                    FROM prompt_weights w JOIN postings p USING (field, term) GROUP BY ALL)"""

KNN_CTE = """
  knn AS (
    SELECT * FROM (
      SELECT query_id, song_id, score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS r
      FROM (SELECT q.query_id, d.song_id,
                   round((1 + list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.vec AS DOUBLE[]))) / 2, 6) AS score
            FROM docs d, queries q WHERE q.vec IS NOT NULL)) WHERE r <= 100)"""

HYBRID_CTE = f"""{FUZZY_CTE}, {KNN_CTE},
  scored AS (
    SELECT query_id, song_id, coalesce(k.score, 0) + coalesce(w.keyword, 0) + coalesce(p.prompt, 0) AS score,
           concat_ws('+', CASE WHEN k.score IS NOT NULL THEN 'vector_search' END,
                     CASE WHEN w.keyword > 0 THEN 'keyword_search' END,
                     CASE WHEN p.prompt > 0 THEN 'prompt_search' END) AS matched
    FROM (SELECT query_id, song_id, score FROM knn) k
    FULL JOIN keyword_scores w USING (query_id, song_id)
    FULL JOIN prompt_scores p USING (query_id, song_id))"""

_top = """SELECT query_id, rank, song_id, score, matched FROM (
    SELECT query_id, song_id, round(score, 6) AS score, matched,
           row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, song_id) AS rank FROM {0})
  WHERE rank <= 20"""

FILTERED_CTE = f"""{HYBRID_CTE},
  passing AS (
    SELECT q.query_id, d.song_id FROM queries q, docs d
    WHERE (energy_min IS NULL OR energy >= energy_min) AND (energy_max IS NULL OR energy <= energy_max)
      AND (popularity_min IS NULL OR popularity >= popularity_min)
      AND (popularity_max IS NULL OR popularity <= popularity_max)
      AND (coalesce(artist, '') = '' OR list_has_any({WORDS.format('name_artists')}, {WORDS.format('artist')}))),
  limited AS (SELECT query_id FROM queries WHERE coalesce(energy_min, energy_max, popularity_min, popularity_max) IS NOT NULL
              OR coalesce(artist, '') <> ''),
  all_hits AS (
    SELECT query_id, song_id, coalesce(s.score, 0) AS score, coalesce(s.matched, '') AS matched
    FROM passing p LEFT JOIN scored s USING (query_id, song_id)
    WHERE s.song_id IS NOT NULL OR query_id IN (SELECT query_id FROM limited)),
  hits AS ({_top.format('all_hits')})"""

_search = lambda body: with_views(SEARCH_VIEWS, body)


def _clause_top(cte: str, table: str, column: str) -> str:
    return _search(
        f"""WITH {cte} SELECT query_id, song_id, score, rank FROM (
        SELECT query_id, song_id, round({column}, 6) AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY round({column}, 6) DESC, song_id) AS rank
        FROM {table} WHERE round({column}, 6) > 0) WHERE rank <= 20"""
    )


ORACLES = {
    "knn_top": _search(f"WITH {INDEX_CTE}, {KNN_CTE} SELECT query_id, song_id, score FROM knn"),
    "knn_pruned": _search(f"WITH {INDEX_CTE}, {KNN_CTE} SELECT query_id, song_id, score FROM knn"),
    "keywords_clean": """WITH k AS (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.,]'),
            lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')), lambda x: x <> '') AS k FROM documents)
        SELECT doc_id, len(k) AS n, array_to_string(k, ' ') AS keywords FROM k""",
    "keywords_tfidf": _search(f"WITH {BASE_CTE} SELECT query_id, place, word, weight FROM picked"),
    "keywords_all": _search(f"WITH {BASE_CTE} SELECT query_id, place, word, weight FROM placed"),
    "keywords_answers": with_views(
        "queries",
        """WITH two AS (SELECT query_id, list_slice(string_split_regex(trim(prompt, chr(32) || chr(10)), '[ \\n]+'), 1, 2) AS k,
                               prompt IS NOT NULL AND length(prompt) > 300 AS good FROM queries)
        SELECT query_id, CASE WHEN good THEN len(k) ELSE 0 END AS n,
               CASE WHEN good THEN array_to_string(k, ' ') ELSE '' END AS keywords FROM two""",
    ),
    "bm25_keywords": _clause_top(KEYWORD_CTE, "keyword_scores", "keyword"),
    "bm25_scripts": with_views(
        "lyrics_scripts prompts_scripts",
        f"""WITH {words_by_character('lyrics_scripts', 'song_id', 'lyrics', 'w')},
        {words_by_character('prompts_scripts', 'query_id', 'prompt', 'q')},
        sized AS (SELECT song_id, count(*) AS dl FROM w_words GROUP BY song_id),
        whole AS (SELECT count(*) AS n_docs, sum(dl) / count(*) AS avg_dl FROM sized),
        counted AS (SELECT song_id, term, count(*) AS tf FROM w_words GROUP BY ALL),
        weighed AS (SELECT term, ln(1 + (any_value(n_docs) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM counted, whole GROUP BY term),
        asked AS (SELECT query_id, term, count(*) AS n FROM q_words GROUP BY ALL),
        scored AS (
          SELECT query_id, song_id, round(sum(n * idf * 2.2e0 * tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avg_dl))), 6) AS score
          FROM asked JOIN weighed USING (term) JOIN counted USING (term) JOIN sized USING (song_id), whole GROUP BY ALL)
        SELECT query_id, song_id, score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 20""",
    ),
    "fuzzy_expand": _search(
        f"WITH {FUZZY_CTE} SELECT word, field, term, CAST(dist AS BIGINT) AS dist, round(closeness, 6) AS closeness, df FROM expanded"
    ),
    "fuzzy_expand_all": _search(
        f"""WITH {FUZZY_CTE} SELECT word, field, term, CAST(d AS BIGINT) AS dist,
          round(1 - d / CAST(least(length(word), length(term)) AS DOUBLE), 6) AS closeness,
          max(df) OVER (PARTITION BY word, field) AS df FROM near JOIN terms USING (term)"""
    ),
    "bm25_fuzzy": _clause_top(FUZZY_CTE, "prompt_scores", "prompt"),
    "search_hybrid": _search(f"WITH {HYBRID_CTE} {_top.format('scored')}"),
    "bm25_pruned": _clause_top(KEYWORD_CTE, "keyword_scores", "keyword"),
    "search_single": _search(
        f"WITH {HYBRID_CTE} SELECT * FROM ({_top.format('scored')}) WHERE query_id = (SELECT min(query_id) FROM queries)"
    ),
    "search_filtered": _search(f"WITH {FILTERED_CTE} SELECT * FROM hits"),
    "filter_queries": _search(
        f"""WITH {FILTERED_CTE} SELECT query_id, count(*) AS n_passing, min(song_id) AS first_song
        FROM passing WHERE query_id IN (SELECT query_id FROM limited) GROUP BY query_id"""
    ),
    "search_enriched": with_views(
        SEARCH_VIEWS + " tracks",
        f"""WITH {FILTERED_CTE},
        dates AS (SELECT song_id, max(release_date) AS release_date FROM tracks GROUP BY song_id),
        videos AS (SELECT song_id, max(youtube_music_url) AS url FROM song_links GROUP BY song_id),
        energies AS (SELECT song_id, max(energy) AS energy FROM acoustic_features GROUP BY song_id)
        SELECT h.query_id, h.rank, h.song_id, coalesce(d.song_name, 'Unknown Title') AS title,
          coalesce(d.name_artists, 'Unknown Artist') AS artist, h.score, h.matched, d.spotify_url,
          nullif(v.url, '') AS youtube_music_url, d.popularity, nullif(r.release_date, '') AS release_date,
          coalesce(nullif(e.energy, 0), d.energy) AS energy, d.lyrics, CAST(NULL AS VARCHAR) AS reason
        FROM hits h JOIN docs d ON d.song_id = h.song_id LEFT JOIN dates r ON r.song_id = h.song_id
        LEFT JOIN videos v ON v.song_id = h.song_id LEFT JOIN energies e ON e.song_id = h.song_id""",
    ),
}
