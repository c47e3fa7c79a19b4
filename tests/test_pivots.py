"""Neighbours by bounds against a visit of every vector."""

import random

import numpy as np
import pytest

from cadenza.operators import knn, pivots as pv


def documents(spark, n=1500, clusters=12, dims=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = [(f"s{i:05d}", [c + rng.gauss(0, 0.12) for c in rng.choice(centres)]) for i in range(n)]
    # Equal vectors, opposite ones, other lengths, none.
    rows += [(f"t{i:03d}", [1.0] + [0.0] * (dims - 1)) for i in range(150)]
    rows += [(f"u{i}", [-5.0 * (i + 1)] + [0.0] * (dims - 1)) for i in range(3)] + [("v", None)]
    return spark.createDataFrame(rows, "song_id string, embedding array<float>").repartition(4), centres


def queries(spark, centres, dims=8):
    rng = random.Random(2)
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centre]) for i, centre in enumerate(centres)]
    rows += [(100, [1.0] + [0.0] * (dims - 1)), (101, [0.0] * dims), (102, None), (103, [rng.gauss(0, 1) for _ in range(dims)])]
    return spark.createDataFrame(rows, "query_id long, vec array<float>")


@pytest.mark.parametrize("k, block", [(10, 64), (100, 32), (3000, 64)])
def test_same_neighbours_as_visiting_all(spark, rows, monkeypatch, k, block):
    monkeypatch.setattr(pv, "BLOCK", block)
    docs, centres = documents(spark)
    asked = queries(spark, centres)
    found, visited = pv.nearest_counted(pv.group(docs), asked, k)
    assert rows(found) == rows(knn.nearest(docs, asked, k))
    assert visited.of == (len(centres) + 2) * 1653
    # Clustered vectors are left out group by group.
    assert visited.pairs < visited.of / 2 if k < 3000 else visited.pairs == visited.of


def test_queries_in_parts_and_blocks_without_names(spark, rows, monkeypatch):
    docs, centres = documents(spark, 400)
    asked = queries(spark, centres)
    held = pv.group(docs)
    monkeypatch.setattr(pv, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(pv, "NAMED_BLOCKS", 2)
    assert rows(pv.nearest(held, asked, 7)) == rows(knn.nearest(docs, asked, 7))
    monkeypatch.setattr(pv, "MOST_BLOCKS", 1)
    assert pv.nearest(held, asked, 7) is None


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(3)
    unit = knn._unit(rng.normal(size=(300, 5)))
    pivots, asked = unit[:9], knn._unit(rng.normal(size=(40, 5)))
    angles = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    own = angles.argmin(axis=1)
    mine = [angles[own == p, p] for p in range(9)]
    blocks = {"pivot": np.arange(9), "inner": np.array([m.min() for m in mine]), "outer": np.array([m.max() for m in mine])}
    least, largest = pv.bounds(asked, pivots, blocks)
    true = np.arccos(np.clip(asked @ unit.T, -1, 1))
    for p in range(9):
        assert (true[:, own == p] >= least[:, [p]]).all() and (true[:, own == p] <= largest[:, [p]]).all()


def test_nothing_to_find(spark):
    docs, centres = documents(spark, 50)
    held = pv.group(docs)
    assert pv.nearest(held, queries(spark, centres).limit(0), 5).count() == 0
    assert pv.nearest(pv.group(docs.limit(0)), queries(spark, centres), 5).count() == 0


def test_hybrid_search_by_bounds_is_the_same(spark, rows, monkeypatch, tmp_path):
    from cadenza.operators import hybrid as hy
    from cadenza.sources import index_store

    docs, centres = documents(spark, 300)
    whole = docs.filter("embedding IS NOT NULL").selectExpr(
        "song_id", "concat('song ', song_id) AS song_name", "concat('words w', hash(song_id) % 20) AS lyrics", "1 AS popularity",
        "'Band' AS name_artists", "'u' AS spotify_url", "embedding", "0.5D AS energy",
    )
    index = index_store.save_index(whole, "pivots_test", str(tmp_path / "index"), 4)
    asked = queries(spark, centres).selectExpr("query_id", "concat('words w', query_id) AS prompt", "vec")
    plain = rows(hy.search(index, asked))
    monkeypatch.setattr(pv, "LEAST_PRODUCTS", 0)
    assert rows(hy.search(index, asked)) == plain
    again = index_store.open_index(spark, "pivots_test", str(tmp_path / "index"))
    assert rows(pv.nearest(again.groups, asked, 9)) == rows(knn.nearest(whole, asked, 9))
