import random

from pyspark.sql import functions as F

from cadenza.functions import distance as ds

LETTERS = "abcé"


def osa(a: str, b: str) -> int:
    """Plain table computation of the distance."""
    table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                best = min(best, table[i - 2, j - 2] + 1)
            table[i, j] = best
    return table[len(a), len(b)]


def changed(rng: random.Random, word: str) -> str:
    letters = list(word)
    for _ in range(rng.randint(0, 3)):
        kind, at = rng.randint(0, 3), rng.randrange(len(letters) + 1)
        if kind == 0:
            letters.insert(at, rng.choice(LETTERS))
        elif kind == 1 and at < len(letters):
            letters.pop(at)
        elif kind == 2 and at < len(letters):
            letters[at] = rng.choice(LETTERS)
        elif at + 1 < len(letters):
            letters[at], letters[at + 1] = letters[at + 1], letters[at]
    return "".join(letters)


def test_distance_and_keys(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice(LETTERS) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 8, 12, 19, 20, 21, 23, 40) * 200]
    pairs = [(w, changed(rng, w)) for w in words]
    pairs = [(a, b) for a, b in pairs if b]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    meet = F.arrays_overlap(ds.search_keys(a), ds.vocabulary_keys(b))
    near = 0
    limits = [ds.osa_within(a, b, F.lit(n)).alias(f"d{n}") for n in range(3)]
    for r in df.select("a", "b", *limits, meet.alias("meet"), ds.allowed_edits(a).alias("k")).collect():
        d = osa(r.a, r.b)
        assert [r.d0, r.d1, r.d2] == [d if d <= n else None for n in range(3)], r
        if d <= r.k:
            near += 1
            assert r.meet, r
    assert near > 1000


def test_literal_cases(spark):
    pairs = [("teh", "the", 1), ("é", "e", 1), ("ca", "abc", None), ("abcdef", "badcef", 2), ("leelle", "ellele", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    for r in df.select("a", "b", "d", ds.osa_within(F.col("a"), F.col("b"), F.lit(2)).alias("got")).collect():
        assert r.got == r.d, r


def test_allowed_edits(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("abcde",), ("abcdef",), ("éé",)], "w string")
    assert [r[0] for r in df.select(ds.allowed_edits(F.col("w"))).collect()] == [0, 1, 1, 2, 0]
