import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import lexical_search
from cadenza.llm.lexical_search import Best, ItemTile
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    """Ranks by the definition, in Python's whole numbers."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        asked, found = Counter(terms(text)), []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, k in asked.items()
                if t in c
            )
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item_id, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def items_of(rng):
    return [(i, cases.sentence(rng, rng.randint(1, 30))) for i in range(25)] + [
        (50, None), (51, ""), (52, "...!?"), (53, "nothing-of-the-kind zzz"), (54, "中文 😀 ÄÖ É"), (55, "the " * 3000), (None, "Alpha beta"),
    ]


@pytest.mark.parametrize("item_bytes", [1 << 20, 300])
def test_ranks_follow_the_definition(spark, item_bytes):
    rng = random.Random(5)
    rows = cases.documents()
    items = items_of(rng)
    # Extra columns with names used inside.
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS item", "'y' AS score")
    found = lexical_search.best_documents(cases.frame(spark, rows), asked, item_bytes=item_bytes, tile_items=4)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == plain([(r[0], r[1]) for r in rows], items)


def test_many_ties_take_the_smallest_ids(spark):
    rng = random.Random(6)
    rows = [(i, "same words in all of them", "en", "s", 0) for i in rng.sample(range(10_000), 700)] + [(-5, "other text", "en", "s", 0)]
    items = [(1, "same"), (2, "other words")]
    found = lexical_search.best_documents(cases.frame(spark, rows, 9), spark.createDataFrame(items, "item_id long, text string"), top=25)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain([(r[0], r[1]) for r in rows], items, 25)


def test_long_text_is_read_in_stretches(spark, monkeypatch):
    rng = random.Random(7)
    words = [cases.sentence(rng, 5) for _ in range(60_000)]
    rows = [(1, " ".join(words), "en", "s", 0), (2, "x" * 3_000_000, "en", "s", 0), (3, "alpha x", "en", "s", 0)]
    items = [(1, "alpha gámma"), (2, "x" * 3_000_000)]
    found = lexical_search.best_documents(cases.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain([(r[0], r[1]) for r in rows], items)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical_search.best_documents(cases.frame(spark, []), items).collect() == []
    assert lexical_search.best_documents(cases.frame(spark, cases.documents()), items.limit(0)).collect() == []


def test_matrices_are_split_where_sums_could_pass_the_bound():
    rng = np.random.default_rng(1)
    weights = rng.integers(1, 20_000, 50)
    items = [(i, Counter({int(w): int(rng.integers(1, 2000)) for w in rng.choice(50, 20, replace=False)})) for i in range(6)]
    dense = rng.integers(0, lexical_search.IMPACT_BOUND, (40, 50)).astype(float)
    want = [[sum(int(dense[d, w]) * int(weights[w]) * n for w, n in c.items()) for _, c in items] for d in range(40)]
    for exact in (1 << 53, 1 << 44):
        tile = ItemTile(items, weights, exact)
        assert len(tile.parts) > (exact < 1 << 53)
        for _, matrix in tile.parts:
            assert matrix.sum(axis=0).max() * lexical_search.IMPACT_BOUND < exact
        assert tile.scores(dense, [w for w, _ in tile.parts]).tolist() == want


def test_best_keeps_order_over_tiles():
    rng = np.random.default_rng(2)
    best, rows = Best(3, 5), []
    for _ in range(30):
        ids, scores = rng.integers(0, 10_000, 8), rng.integers(0, 6, (8, 3))
        best.add(ids, np.arange(3), scores)
        rows += [(i, -s, d) for d, line in zip(ids.tolist(), scores.tolist()) for i, s in enumerate(line) if s > 0]
    want = {i: sorted(r for r in rows if r[0] == i)[:5] for i in range(3)}
    assert [(i, -s, d) for i, d, s in best.rows()] == [r for i in range(3) for r in want[i]]
