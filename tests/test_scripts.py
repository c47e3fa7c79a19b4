"""Search over lyrics of mixed scripts against a plain computation."""

import math
import re
from collections import Counter, defaultdict

from cadenza.operators import index as ix
from cadenza.plans import search_plans as sp
from cadenza.sources import index_store

DOCS = [
    (1, "bcd bcd fgh", "en"), (2, "BCD klm klm klm wxz", "fr"), (3, "eee bcd tk", "de"), (4, "e t klm", "de"),
    # Rows of one song: of one length, so counted together, and of another.
    (5, "bcd fgh", "en"), (5, "fgh klm", "en"), (5, "bcd", "en"), (None, "bcd fgh pqv", "en"), (None, "bcd bcd pqv", "en"),
    (6, None, "en"), (7, "", "de"), (8, " .,! ", "en"),
]
PROMPTS = [(1, "bcd fgh"), (2, "e klm klm t"), (3, None), (4, "zzz"), (5, "pqv wxz bcd")]


def tokens(text, changed):
    return re.findall("[a-z]+|[東京]", (text or "").lower().translate(str.maketrans("et", "東京") if changed else {}))


def plain_scores():
    cut = [(None if d is None else str(d), tokens(text, lang == "de")) for d, text, lang in DOCS]
    sizes = [len(w) for _, w in cut if w]
    n_docs, avg_dl = len(sizes), sum(sizes) / len(sizes)
    tf = Counter((song, len(w), term) for song, w in cut for term in w)
    df = Counter(term for _, _, term in tf)
    scores = defaultdict(float)
    for query, prompt in PROMPTS:
        for term, n in Counter(tokens(prompt, query % 2 == 0)).items():
            for (song, dl, held), k in tf.items():
                if held == term:
                    idf = math.log(1 + (n_docs - df[term] + 0.5) / (df[term] + 0.5))
                    scores[query, song] += n * idf * 2.2 * k / (k + 1.2 * (0.25 + 0.75 * dl / avg_dl))
    return {key: round(value, 6) for key, value in scores.items()}


def stored(spark, tmp_path):
    docs = [(d, text, lang, "src", 0) for d, text, lang in DOCS]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(PROMPTS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_scripts_search_cuts_texts_into_words_once(spark, tmp_path):
    found = sp.bm25_scripts(spark, stored(spark, tmp_path))
    assert {(r.query_id, r.song_id): round(r.score, 6) for r in found.collect()} == plain_scores()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Counts are stored, and of the sums only a page per query and task is shuffled.
    assert "regexp_extract_all" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning")[1]


def test_stored_counts_are_those_of_the_texts(spark, tmp_path, rows):
    docs = [(None if d is None else str(d), text, None, lang) for d, text, lang in DOCS]
    docs = spark.createDataFrame(docs, "song_id string, lyrics string, song_name string, name_artists string")
    counts, fields = index_store.save_counts(docs, f"counts_{tmp_path.name}".replace("-", "_"), str(tmp_path / "counts"), 4)
    lazy, kept = ix.build_index(docs), ix.build_index(docs, counts, fields)
    for part in ("postings", "terms", "fields", "keys"):
        columns = getattr(lazy, part).columns
        assert rows(getattr(kept, part).select(columns)) == rows(getattr(lazy, part)), part
    empty = docs.limit(0)
    counts, fields = index_store.save_counts(empty, f"none_{tmp_path.name}".replace("-", "_"), str(tmp_path / "none"), 4)
    assert counts.count() == 0 and fields.count() == 0
