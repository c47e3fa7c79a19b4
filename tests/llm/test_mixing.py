import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.llm import mixing
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares by weight; what is above a limit is shared again among the others, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    left, free = share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in sorted(free, key=str):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free = free - {s}
    return target


def check(rows, result):
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in result) == sorted(
        (d is None, d, len(WORD.findall(t or ""))) for d, t, *_ in rows
    ) or sorted(map(repr, ((r.doc_id, r.size) for r in result))) == sorted(repr((d, len(WORD.findall(t or "")))) for d, t, *_ in rows)
    of_source = {}
    for r in result:
        of_source.setdefault((r.source_size, round(r.target, 3)), []).append(r)
        assert r.taken <= 2 * r.size
        if r.size:
            each = min(2.0, r.target / r.source_size)
            assert r.taken // r.size in {int(each), int(each) + 1, int(each + 1e-9)} and r.taken % r.size == 0
    assert set(of_source) <= {(sizes[s], round(want[s], 3)) for s in sizes}
    return of_source


def awkward(spark):
    rows = cases.documents()
    rng = random.Random(3)
    rows += [(1000 + i, cases.sentence(rng, rng.randint(1, 80)), "en", rng.choice(["a", "b", "B", "ä", "😀", "", "zz"]), 0) for i in range(600)]
    return rows


def test_sizes_targets_and_copies(spark):
    rows = awkward(spark)
    result = mixing.mix(cases.frame(spark, rows)).collect()
    groups = check(rows, result)
    for (_, target), members in groups.items():
        assert abs(sum(r.taken for r in members) - target) <= max(r.size for r in members) + 1e-6
    whole = sum(r.size for r in result)
    assert abs(sum(r.taken for r in result) - 1.5 * whole) <= max(r.size for r in result)


def test_runs_and_partitions_agree(spark):
    rows = awkward(spark)
    first = sorted(map(repr, mixing.mix(cases.frame(spark, rows, 3)).collect()))
    assert first == sorted(map(repr, mixing.mix(cases.frame(spark, rows[::-1], 7)).collect()))


def test_many_equal_rows_share_their_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 10)
    rows = [(1, "one two three", "en", "a", 0)] * 95 + [(2, "four five", "en", "b", 0)] * 7 + [(3, "x", "en", "c", 0)]
    result = mixing.mix(cases.frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in result) == {1: 95, 2: 7, 3: 1}
    for members in check(rows, result).values():
        assert abs(sum(r.taken for r in members) - members[0].target) <= max(r.size for r in members)


def test_probabilities_are_kept_over_seeds(spark):
    items = spark.range(40).selectExpr("id AS item", "id % 4 AS group", "1 + id % 7 AS size", "0.3D AS p")
    total = defaultdict(int)
    runs = 8
    for seed in range(runs):
        found = {r.item: r.taken for r in mixing.rounded(items, 1000 * seed, block=8).collect()}
        assert len(found) == 40
        for item, taken in found.items():
            total[item] += taken
        # Words are kept up to the one document that was left.
        words = sum((1 + i % 7) * t for i, t in found.items())
        assert abs(words - 0.3 * sum(1 + i % 7 for i in range(40))) < 7
    assert abs(sum(total.values()) / (40 * runs) - 0.3) < 0.05
    # Every document has its chance.
    assert sum(n > 0 for n in total.values()) > 30 and all(n < runs for n in total.values())


@pytest.mark.parametrize("block", [2, 64])
def test_levels_leave_one_of_each_group(spark, block):
    items = spark.range(3000).selectExpr("id AS item", "if(id % 3 = 0, 0L, id % 50) AS group", "1 + id % 5 AS size", "0.25D AS p")
    found = mixing.rounded(items, 1, block).groupBy("item").agg(F.count("*").alias("n"), F.max("taken").alias("taken")).collect()
    assert len(found) == 3000 and {r.n for r in found} == {1} and {r.taken for r in found} == {0, 1}


def test_mixed_documents_are_repeated(spark):
    rows = awkward(spark)
    docs = cases.frame(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        if r.size:
            want[r.doc_id] += r.taken // r.size
    for r in out.collect():
        if WORD.search(r.text or ""):
            got[r.doc_id] += 1
    assert got == +want


def test_empty_and_wordless(spark):
    assert mixing.mix(cases.frame(spark, [])).collect() == []
    rows = [(1, None, "en", None, 0), (2, " \n", "en", "a", 0)]
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(cases.frame(spark, rows)).collect()} == {
        (1, 0, 0, 0.0, 0),
        (2, 0, 0, 0.0, 0),
    }


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(cases.frame(spark, cases.documents()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
