"""Pruned reading of stored lists against sums over all postings."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import hybrid as hy, lexical as lx, term_lists as tl
from cadenza.sources import index_store

DOCUMENTS = "song_id string, song_name string, lyrics string, popularity int, name_artists string, spotify_url string, embedding array<float>, energy double"


def some_documents(n=600):
    """Words of very different frequency; w0 is in nearly every text, w199 in few."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.randint(3, 60)))
        rows.append((f"s{i:04d}", " ".join(rng.choices(words, weights, k=3)), text, 1, "Band", "u", [rng.gauss(0, 1) for _ in range(3)], 0.5))
    return rows


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    before = tl.BLOCK
    # Small blocks, so that lists have several.
    tl.BLOCK = 32
    documents = spark.createDataFrame(some_documents(), DOCUMENTS)
    yield index_store.save_index(documents, "lists_test", str(tmp_path_factory.mktemp("lists")), 8)
    tl.BLOCK = before


def asked(spark, index, prompts):
    queries = spark.createDataFrame([(i, p, p.split()) for i, p in enumerate(prompts)], "query_id long, prompt string, keywords array<string>")
    return hy.clause_weights(index, queries, lx.batch_size(queries))


def top(rows, n):
    found = {}
    for r in rows:
        score = round(r.keyword + r.prompt, 6)
        if score > 0:
            found.setdefault(r.query_id, []).append((-score, r.song_id, round(r.keyword, 6)))
    return {q: sorted(hits)[:n] for q, hits in found.items()}


PROMPTS = ["w0 w150 w3", "w0", "w199 w198 w0 w1 w2", "w5 w6 w7 w8", "nowhere", "w120", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"]


@pytest.mark.parametrize("n", [1, 5, 20, 1000])
def test_best_songs_are_those_of_all_postings(spark, index, n):
    weights = asked(spark, index, PROMPTS)
    found = tl.best_songs(index, weights, n).collect()
    whole = lx.score_postings(index, weights).collect()
    assert top(found, n) == top(whole, n)
    if n == 1:
        # Far fewer songs are looked at.
        assert len(found) < len(whole)


def test_named_songs_get_their_whole_scores(spark, index):
    weights = asked(spark, index, ["w0 w150 w3"])
    also = spark.createDataFrame([(0, f"s{i:04d}") for i in range(40)] + [(0, "unknown")], "query_id long, song_id string")
    found = {r.song_id: round(r.keyword + r.prompt, 6) for r in tl.best_songs(index, weights, 2, also).collect()}
    whole = {r.song_id: round(r.keyword + r.prompt, 6) for r in lx.score_postings(index, weights).collect()}
    named = {f"s{i:04d}" for i in range(40)}
    assert {s: v for s, v in found.items() if s in named} == {s: v for s, v in whole.items() if s in named}


def test_lists_hold_all_postings_in_small_blocks(spark, index):
    sizes = index.lists.select(F.size("songs").alias("n"), "block").collect()
    assert len({r.block for r in sizes}) == len(sizes) and max(r.n for r in sizes) < 4 * 32
    rows = index.lists.select("field", "term", F.inline(F.arrays_zip("songs", "impacts")))
    kept = {(r.field, r.term, r.songs, r.impacts) for r in rows.collect()}
    assert kept == {(r.field, r.term, r.song_id, r.impact) for r in index.postings.collect()}
    most = {(r.field, r.term): r.most for r in index.terms.collect()}
    assert all(impact <= most[field, term] for field, term, _, impact in kept)


def test_one_request_reads_the_buckets_of_its_words(spark, index):
    named = spark.createDataFrame([("lyrics", "w150"), ("lyrics", "w120")], "field string, term string")
    found = tl.asked_postings(index, named)
    read, of = tl.buckets_read(found)
    assert of == 8 * index_store.LIST_BUCKETS and 0 < read <= 4
    again = index_store.open_index(spark, "lists_test", index.documents.inputFiles()[0].rsplit("/", 3)[0])
    assert tl.buckets_read(tl.asked_postings(again, named)) == (read, of)


def test_too_many_blocks_are_read_by_song(spark, index, monkeypatch):
    weights = asked(spark, index, PROMPTS)
    whole = top(lx.score_postings(index, weights).collect(), 5)
    monkeypatch.setattr(tl, "MOST_BLOCKS", 3)
    assert tl.best_songs(index, weights, 5) is None and tl.asked_postings(index, weights) is None
    assert top(lx.score_postings(index, weights).collect(), 5) == whole


def test_long_lists_are_left_where_they_cannot_matter():
    lists = [tl.AskedList(0, "f", w, df, most) for w, df, most in (("a", 10, 5.0), ("b", 1000, 1.0), ("c", 500, 0.5), ("d", 20, 3.0))]
    assert [a.term for a in tl.first_lists(lists)] == ["a"]
    # b and c together stay below 2, so a song needs a or d.
    assert {a.term for a in tl.needed_lists(lists, 2.0)} == {"a", "d"}
    assert {a.term for a in tl.needed_lists(lists, 1.2)} == {"a", "c", "d"}
    assert {a.term for a in tl.needed_lists(lists, 0.0)} == {"a", "b", "c", "d"}


def test_postings_are_shuffled_once_to_their_buckets(spark, index, monkeypatch):
    def held(df):
        return {(r.block, r.field, r.term, r.part, tuple(r.songs), tuple(r.impacts)) for r in df.collect()}

    lists = tl.term_lists(index.postings, index.terms, 32)
    plan = lists.repartition(32, "block")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert held(lists) == held(index.lists)
    # Also where too many words have several blocks to send them all.
    monkeypatch.setattr(tl, "MOST_SENT", 0)
    assert held(tl.term_lists(index.postings, index.terms, 32)) == held(index.lists)
