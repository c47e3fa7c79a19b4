import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import simhash as sh
from cadenza.llm.components import components
from tests.llm import cases


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def plain_components(fps, most=3):
    """Index of the first fingerprint that each is connected to."""
    values = np.array(fps, dtype=np.uint64)
    root = np.arange(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= most):
            a, b = sorted((root[i], root[j]))
            root[root == b] = a
    return root


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprints_and_components_of_awkward_documents(spark):
    rows = cases.documents()
    found = sh.near_duplicates(cases.frame(spark, rows)).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(fps)
    least = {}
    for (doc_id, *_), root in zip(rows, roots):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    expected = [(r[0], signed(fp), least.get(root)) for r, fp, root in zip(rows, fps, roots)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("block", [2, 7, 1024])
@pytest.mark.parametrize("most", [0, 1, 3])
def test_links_connect_what_all_pairs_connect(spark, rows, block, most):
    rng = random.Random(block)
    fps = {0, 2**64 - 1}
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 20])):
            x = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            fps.add(x)
    # Many fingerprints that share a half.
    fps |= {0xABCDEF << 32 | rng.getrandbits(12) for _ in range(60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = [tuple(r) for r in sh.links(df, most, block).collect()]
    by_value = {signed(x): x for x in fps}
    assert all((by_value[a] ^ by_value[b]).bit_count() <= most for a, b in links)
    roots = {r.node: r.root for r in components(sh.links(df, most, block)).collect()}
    groups = {}
    for x, root in zip(fps, plain_components(fps, most)):
        groups.setdefault(root, set()).add(roots.get(signed(x), signed(x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_dense_group_emits_a_spanning_set(spark):
    fps = [(1 << 40 | i,) for i in range(300)]
    df = spark.createDataFrame(fps, "fp long")
    assert sh.links(df, 3, 64).count() < 30 * 300


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (3, 2)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = cases.documents()
    df = cases.frame(spark, rows)
    kept = sh.keep_one(df)
    assert kept.columns == df.columns
    roots = plain_components([plain_fingerprint(r[1]) for r in rows])
    by_root = {}
    for r, root in zip(rows, roots):
        by_root.setdefault(root, []).append(r[0])
    least = [min(ids, key=lambda d: (d is None, d or 0)) for ids in by_root.values()]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(least, key=repr)
    assert all(r.kept == (None if r.doc_id is None else f"own {r.doc_id}") for r in kept.collect())
    assert sh.keep_one(cases.frame(spark, [])).count() == 0


def test_more_bits_than_two_halves_can_find_are_refused(spark):
    with pytest.raises(ValueError):
        sh.links(spark.range(1).select(F.col("id").alias("fp")), 4)
