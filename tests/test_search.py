"""Search against a plain computation over every query and document of a small collection."""

import math
import random
import re

import pytest

from cadenza.operators import enrich as en, filters as fl, hybrid as hy, index as ix, knn, lexical as lx
from cadenza.sources import index_store
from tests.test_distance import osa

BOOST = {"song_name": 3.0, "name_artists": 2.0, "lyrics": 1.0}
DOC_SCHEMA = (
    "song_id string, song_name string, lyrics string, popularity int, name_artists string, "
    "spotify_url string, embedding array<float>, energy double"
)
QUERY_SCHEMA = (
    "query_id long, prompt string, keywords array<string>, vec array<float>, energy_min double, "
    "energy_max double, artist string, popularity_min int, popularity_max int"
)


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def make_documents():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    docs = []
    for i in range(60):
        vec = [rng.gauss(0, 1) for _ in range(4)]
        docs.append(
            (
                f"s{i:02d}", " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=rng.randint(0, 30))),
                rng.choice([None, 0, 30, 99, 250]), rng.choice(["The Band", "Other Band", "Solo", None]), f"u{i}", vec,
                rng.choice([None, 0.0, 0.3, 0.9]),
            )
        )
    # Copies of one vector: ties must go to the smaller id.
    docs += [(f"t{i:02d}", "copy", None, 50, "Copy", None, [1.0, 0.0, 0.0, 0.0], 0.5) for i in range(120)]
    return docs, words


def make_queries(words):
    rng = random.Random(12)

    def spoiled(word):
        return word[1:] if len(word) > 3 and rng.random() < 0.4 else word

    none = (None,) * 5
    filters = [
        none, none, (0.3, None, None, None, None), (None, 0.0, None, None, None), (None, None, "band nobody", None, None),
        (None, None, "", None, None), (None, None, None, 30, 99), (None, None, "!!", None, None), (0.1, 0.95, "solo", 0, None),
        (None, None, None, 200, None),
    ]
    queries = []
    for i, chosen in enumerate(filters):
        prompt = " ".join(spoiled(w) for w in rng.choices(words, k=4)) if i != 6 else "zzzzzzzzz"
        vec = [1.0, 0.0, 0.0, 0.0] if i == 1 else [rng.gauss(0, 1) for _ in range(4)]
        queries.append((i, prompt, [] if i == 6 else [f" {w} " for w in rng.choices(words, k=2)], vec, *chosen))
    return queries


def expected_hits(docs, queries, size, neighbours=100):
    """Scores of every query and document by the definition."""
    texts = {f: {d[0]: tokens(d[p]) for d in docs} for f, p in (("song_name", 1), ("name_artists", 4), ("lyrics", 2))}
    n_docs = {f: sum(1 for w in t.values() if w) for f, t in texts.items()}
    avg = {f: sum(map(len, t.values())) / n_docs[f] for f, t in texts.items()}
    df = {f: {} for f in texts}
    for f, t in texts.items():
        for found in t.values():
            for w in set(found):
                df[f][w] = df[f].get(w, 0) + 1

    def weight(field, count, frequency, length):
        idf = math.log(1 + (n_docs[field] - frequency + 0.5) / (frequency + 0.5))
        return BOOST[field] * 2.2 * idf * count / (count + 1.2 * (0.25 + 0.75 * length / avg[field]))

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    result = {}
    for query in queries:
        qid, prompt, keywords, vec, e_min, e_max, artist, p_min, p_max = query
        near = sorted((-round((1 + cosine(vec, d[6])) / 2, 6), d[0]) for d in docs)[:neighbours]
        vector = {doc: -score for score, doc in near}
        terms = {}
        for w in tokens(prompt):
            k = 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
            for f in texts:
                found = sorted((1 - (1 - osa(w, t) / min(len(w), len(t))), t) for t in df[f] if osa(w, t) <= k)[:50]
                if found:
                    top = max(df[f][t] for _, t in found)
                    for loss, t in found:
                        terms.setdefault(f, []).append((t, 1 - loss, top))
        hits = []
        for d in docs:
            doc = d[0]
            keyword = sum(
                weight(f, texts[f][doc].count(w), df[f][w], len(texts[f][doc]))
                for w in tokens(" ".join(keywords)) for f in texts if w in texts[f][doc]
            )
            prompt_score = sum(
                close * weight(f, texts[f][doc].count(t), top, len(texts[f][doc]))
                for f, found in terms.items() for t, close, top in found if t in texts[f][doc]
            )
            names = [n for n, ok in (("vector_search", doc in vector), ("keyword_search", keyword > 0), ("prompt_search", prompt_score > 0)) if ok]
            limited = any(x is not None for x in (e_min, e_max, p_min, p_max)) or bool(artist)

            def inside(x, lo, hi):
                return (lo is None and hi is None) or (x is not None and (lo is None or x >= lo) and (hi is None or x <= hi))

            passes = inside(d[7], e_min, e_max) and inside(d[3], p_min, p_max)
            passes = passes and (not artist or bool(set(tokens(artist)) & set(tokens(d[4]))))
            if passes and (names or limited):
                hits.append((-round(vector.get(doc, 0) + keyword + prompt_score, 6), doc, tuple(names)))
        result[qid] = [(doc, -score, names) for score, doc, names in sorted(hits)[:size]]
    return result


def as_lists(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.song_id, r.score, tuple(r.matched_queries)))
    return out


def assert_same(got, want):
    assert set(got) == {q for q, hits in want.items() if hits}
    for q, hits in got.items():
        assert [h[0] for h in hits] == [h[0] for h in want[q]], q
        assert [h[2] for h in hits] == [h[2] for h in want[q]], q
        assert [h[1] for h in hits] == pytest.approx([h[1] for h in want[q]], abs=2e-6)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    docs, words = make_documents()
    queries = make_queries(words)
    path = str(tmp_path_factory.mktemp("index"))
    index = index_store.save_index(spark.createDataFrame(docs, DOC_SCHEMA), "t_search", path, 3)
    return docs, queries, index, spark.createDataFrame(queries, QUERY_SCHEMA), path


def test_search_matches_the_definition(world):
    docs, queries, index, asked, _ = world
    assert_same(as_lists(hy.search(index, asked, size=15)), expected_hits(docs, queries, 15))


def test_large_batches_give_the_same_hits(world, monkeypatch):
    docs, queries, index, asked, _ = world
    nearest = knn.nearest
    monkeypatch.setattr(lx, "FEW_QUERIES", 0)
    monkeypatch.setattr(lx, "SMALL_ROWS", 0)
    monkeypatch.setattr(lx, "PAIRS_PER_TASK", 7)
    monkeypatch.setattr(knn, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(knn, "nearest", lambda d, q, k=100: nearest(d, q, k, small_query_bytes=400))
    assert_same(as_lists(hy.search(index, asked, size=15)), expected_hits(docs, queries, 15))


def test_reopened_index_gives_the_same_hits(spark, world):
    docs, queries, _, asked, path = world
    index = index_store.open_index(spark, "t_reopened", path)
    assert_same(as_lists(hy.search(index, asked, size=5)), expected_hits(docs, queries, 5))


def test_unsaved_index_gives_the_same_hits(spark, world):
    docs, queries, _, asked, _ = world
    index = ix.build_index(spark.createDataFrame(docs, DOC_SCHEMA))
    assert_same(as_lists(hy.search(index, asked, size=5)), expected_hits(docs, queries, 5))


def test_require_match_drops_hits_of_score_zero(world):
    _, _, index, asked, _ = world
    hits = hy.search(index, asked, size=200, require_match=True)
    assert hits.filter("size(matched_queries) = 0").count() == 0
    assert hy.search(index, asked, size=200).filter("size(matched_queries) = 0").count() > 0


def test_own_page_size(world):
    from pyspark.sql import functions as F

    _, _, index, asked, _ = world
    sized = asked.withColumn("size", F.when(F.col("query_id") == 0, 3))
    counts = {r.query_id: r["count"] for r in hy.search(index, sized, size=7).groupBy("query_id").count().collect()}
    assert counts[0] == 3 and counts[1] == 7


def test_postings_are_not_shuffled_for_small_batches(world):
    _, _, index, asked, _ = world
    weights = hy.clause_weights(index, asked, lx.batch_size(asked))
    plan = lx.score_postings(index, weights)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_tasks_cut_their_rows_to_a_page_before_the_shuffle(world):
    from pyspark.sql import functions as F

    _, _, index, asked, _ = world
    sized = asked.withColumn("size", F.col("query_id").cast("int") + 1)
    plan = hy.search(index, sized, require_match=True)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 10, Partial" in plan


def test_ties_of_copies_go_to_the_smaller_id(world):
    _, _, index, asked, _ = world
    got = sorted(r.song_id for r in knn.nearest(index.documents, asked.filter("query_id = 1"), k=10).collect())
    assert got == [f"t{i:02d}" for i in range(10)]


def test_neighbours_agree_with_the_column_expression(world, rows):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cadenza.functions.vectors import cosine

    docs, _, index, asked, _ = world
    pairs = index.documents.select("song_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("query_id"))
    pairs = pairs.join(asked.select("query_id", "vec"), "query_id")
    score = F.round((1 + cosine(F.col("embedding"), F.col("vec"))) / 2, 6).alias("score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "song_id")
    plain = pairs.select("query_id", "song_id", score).withColumn("r", F.row_number().over(best)).filter("r <= 9").drop("r")
    assert rows(knn.nearest(index.documents, asked, k=9)) == rows(plain)


def test_single_request(spark, world):
    docs, queries, index, _, _ = world
    _, prompt, keywords, vec, *_ = queries[8]
    asked = hy.request(spark, prompt, vec, keywords, size=4, energy_min=0.1, energy_max=0.95, artist="solo", popularity_min=0)
    want = expected_hits(docs, [(0, *queries[8][1:])], 4)
    assert_same(as_lists(hy.search(index, asked)), want)
    # Without a vector or keywords, the prompt alone finds.
    hits = hy.search(index, hy.request(spark, prompt)).collect()
    assert hits and {name for r in hits for name in r.matched_queries} == {"prompt_search"}


def test_suggested_keywords_are_bounded(world):
    _, _, index, asked, _ = world
    filled = lx.with_suggested_keywords(index, asked, 3)
    assert filled.count() == asked.count()
    assert max(len(r.keywords or []) for r in filled.collect()) <= 3
    uncut = lx.suggest_keywords(index, asked).collect()
    assert {(r.query_id, r.place, r.word) for r in lx.suggest_keywords(index, asked, most=3).collect()} == {
        (r.query_id, r.place, r.word) for r in uncut if r.place <= 3
    }


def test_keywords_of_a_model(spark):
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", "bad", None, "none"])], "query_id long, prompt string")

    def answers(prompts):
        if "raise" in prompts:
            raise RuntimeError("no model")
        said = {"a": '{"keywords": [" x ", "", 7]}', "b": '{"other": []}', "bad": "keywords: x", "none": None}
        return [said[p] for p in prompts]

    got = {r.query_id: r.keywords for r in lx.with_keywords(asked, answers).collect()}
    assert got == {0: ["x", "7"], 1: [], 2: ["x", "7"], 3: [], 4: None, 5: []}
    failing = spark.createDataFrame([(0, "raise"), (1, "a")], "query_id long, prompt string")
    assert {r.query_id: r.keywords for r in lx.with_keywords(failing, answers, 1).collect()} == {0: [], 1: ["x", "7"]}


def test_range_filter_bounds(spark, rows):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 0.5)], "id int, energy double")
    assert [r[0] for r in rows(fl.range_filter(df, "energy", 0).select("id"))] == [2, 3]
    assert [r[0] for r in rows(fl.range_filter(df, "energy", None, 0.4).select("id"))] == [2]
    assert fl.range_filter(df, "energy").count() == 3


def test_match_filter(spark):
    df = spark.createDataFrame([("The Band",), ("Solo",), (None,)], "name string")
    assert [r[0] for r in fl.match_filter(df, "name", "BAND x").collect()] == ["The Band"]
    assert fl.match_filter(df, "name", "").count() == 3
    assert fl.match_filter(df, "name", "!").count() == 0


def test_enrich(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a", 2.0, ["vector_search"]), (1, 2, "b", 1.0, []), (2, 1, "a", 3.0, []), (3, 1, "a", 4.0, [])],
        "query_id int, rank int, song_id string, score double, matched_queries array<string>",
    )
    docs = spark.createDataFrame(
        [("a", "A", "X", "u", 3, 0.4, "la"), ("b", None, None, None, None, 0.4, None)],
        "song_id string, song_name string, name_artists string, spotify_url string, popularity int, energy double, lyrics string",
    )
    tracks = spark.createDataFrame([("a", "2001"), ("a", "1999"), ("c", "1")], "song_id string, release_date string")
    links = spark.createDataFrame([("a", ""), ("b", "y")], "song_id string, youtube_music_url string")
    features = spark.createDataFrame([("a", 0.0), ("b", 0.7)], "song_id string, energy double")
    split = en.enrich(hits, docs, tracks, links, features, hot_rows=1)
    assert sorted(split.collect()) == sorted(en.enrich(hits, docs, tracks, links, features).collect())
    assert split.count() == 4
    a, b = sorted(split.filter("query_id = 1").collect(), key=lambda r: r.rank)
    assert (a.title, a.artist, a.release_date, a.youtube_music_url, a.energy) == ("A", "X", "2001", None, 0.4)
    assert (b.title, b.artist, b.release_date, b.youtube_music_url, b.energy) == (
        "Unknown Title", "Unknown Artist", None, "y", 0.7,
    )


def test_versions_of_an_index_do_not_mix(spark, world, tmp_path):
    _, _, index, _, _ = world
    one, two = (str(tmp_path / n) for n in ("one", "two"))
    index_store.save_index(index.documents.limit(3), "t_mixed", one, 2)
    index_store.save_index(index.documents.limit(5), "t_mixed", two, 2)
    for path, n in ((one, 3), (two, 5)):
        opened = index_store.open_index(spark, "t_mixed", path)
        assert opened.documents.count() == n and opened.fields.agg({"n_docs": "max"}).first()[0] <= n
    # A build under the same path takes the place of the one before; readers of that keep theirs.
    before = index_store.open_index(spark, "t_mixed", one)
    index_store.save_index(index.documents.limit(4), "t_mixed", one, 2)
    assert before.documents.count() == 3
    assert index_store.open_index(spark, "t_mixed", one).documents.count() == 4


def test_keys_stay_with_their_words(spark, world, rows):
    """One row per word, so that neither the keys nor anything sorted by them is moved while an index is built."""
    from pyspark.sql import functions as F

    from cadenza.functions.distance import vocabulary_keys

    _, _, index, asked, path = world
    assert index.keys.count() == index.terms.select("term").distinct().count()
    want = index.keys.select("term", "keys", F.array_distinct(F.transform(vocabulary_keys(F.col("term")), lambda k: F.hash(k))).alias("want"))
    assert want.filter(F.array_size("keys") != F.array_size("want")).count() == 0
    plan = ix.word_keys(index.terms)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    # They do not move for a batch of search words either, unless that has too many keys.
    words = lx.prompt_words(asked)
    batch = lx.batch_size(asked)
    near = rows(lx.expand_words(index, words, batch))
    plan = lx.expand_words(index, words, batch)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(key" not in plan
    many = lx.BatchSize(**{**vars(batch), "keys": lx.SMALL_ROWS + 1})
    assert near and rows(lx.expand_words(index, words, many)) == near


def test_numbers_shared_by_keys_find_no_other_words(world, rows, monkeypatch):
    from pyspark.sql import functions as F

    _, _, index, asked, _ = world
    words, batch = lx.prompt_words(asked), lx.batch_size(asked)
    near = rows(lx.expand_words(index, words, batch))

    def few_numbers(keys):
        return F.array_distinct(F.transform(keys, lambda key: F.pmod(F.hash(key), F.lit(3))))

    monkeypatch.setattr(lx, "key_numbers", few_numbers)
    monkeypatch.setattr(ix, "key_numbers", few_numbers)
    crowded = ix.Index(index.documents, index.postings, index.terms, index.fields, ix.word_keys(index.terms))
    assert rows(lx.expand_words(crowded, words, batch)) == near


def test_buckets_bound_what_a_task_holds(spark):
    cores = spark.sparkContext.defaultParallelism
    assert index_store.buckets_for(spark, 10) == cores
    # A sum for every song of a bucket and 200 queries stays under a million rows.
    for n in (100_000, 600_000):
        assert 200 * n / index_store.buckets_for(spark, n) <= 1_000_000
