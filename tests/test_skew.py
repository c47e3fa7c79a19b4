import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import skew


@pytest.fixture(scope="module")
def sides(spark):
    """One key holds half of the rows; some keys are null or have no partner."""
    rng = random.Random(3)
    left = [(i, "hot" if i % 2 else rng.choice(["a", "b", "z", None])) for i in range(400)]
    right = [("hot", 1), ("a", 2), ("b", 3), ("b", 4), ("unused", 5)]
    return spark.createDataFrame(left, "id int, k string"), spark.createDataFrame(right, "k string, v int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_many_to_one_is_the_plain_join(sides, rows, how):
    left, right = sides
    plain = left.join(right, "k", how)
    split = skew.join_many_to_one(left, right, ["k"], ["id"], how, hot_rows=20)
    assert rows(split.select(plain.columns)) == rows(plain)


def test_hot_rows_are_split(sides):
    left, right = sides
    hot = skew.hot_keys(left, ["k"], 20)
    parts = skew.spread_hot(left, hot, ["k"], [F.col("id")]).filter("k = 'hot'").select(skew.SALT).distinct().count()
    assert hot.filter("k = 'hot'").first()[skew.PARTS] == 10
    assert parts > 5


def test_one_to_many_is_the_plain_join(sides, rows):
    right, _ = sides
    left = right.sparkSession.createDataFrame([("hot", "x"), ("a", "y"), ("none", "z"), (None, "n")], "k string, name string")
    plain = left.join(right, "k", "left")
    split = skew.join_one_to_many(left, right, ["k"], ["id"], hot_rows=20)
    assert rows(split.select(plain.columns)) == rows(plain)


def test_one_per_key_takes_the_smallest_row(spark, rows):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 9), ("a", "x", 2), ("b", None, None)], "k string, s string, n int")
    assert rows(skew.one_per_key(df, "k")) == [("a", "x", 2), ("b", None, None)]


@pytest.mark.parametrize("width", [3, 10, 65_536])
def test_numbered(spark, width):
    rng = random.Random(1)
    data = [(g, o, rng.random()) for g in "ab" for o in rng.sample(range(500), 120)] + [("c", 7, 0.5), ("c", 7, 0.1)]
    got = skew.numbered(spark.createDataFrame(data, "g string, o int, t double"), ["g"], "o", ["t"], "n", width).collect()
    for group in "abc":
        ordered = sorted((r.o, r.t, r.n) for r in got if r.g == group)
        assert [n for _, _, n in ordered] == list(range(len(ordered)))
    whole = skew.numbered(spark.createDataFrame(data, "g string, o int, t double"), [], "o", ["t", "g"], "n", width).collect()
    assert [r.n for r in sorted(whole, key=lambda r: (r.o, r.t, r.g))] == list(range(len(data)))


def test_running_total(spark):
    from cadenza.operators.skew import running_total

    data = [(i * 7 % 1000, str(i), i % 5) for i in range(400)] + [(3, "tie", 2)]
    df = spark.createDataFrame(data, "seq long, name string, n int")
    got = {(r.seq, r.name): r.before for r in running_total(df, "seq", ["name"], df.n, "before", width=10).collect()}
    expected, total = {}, 0
    for seq, name, n in sorted(data):
        expected[seq, name] = total
        total += n
    assert got == expected
