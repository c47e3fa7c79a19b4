"""Tables laid out by value, and songs found by a part of their name."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import filters as fl
from cadenza.session import new_path
from cadenza.sources import clustered as cl, name_index as ni

VALUES = "song_id string, energy float, popularity int"


def some_values(n, seed=3):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        energy = None if rng.random() < 0.1 else 0.5 if rng.random() < 0.3 else rng.random()
        popularity = None if rng.random() < 0.1 else rng.choice([50, 50, rng.randint(0, 100)])
        made.append((f"s{i:05d}", energy, popularity))
    return [*made, ("nan", float("nan"), 3), *made[:20]]


RANGES = [
    {"energy": [(0.2, 0.3)]},
    {"popularity": [(90, None)]},
    {"energy": [(None, 0.05)], "popularity": [(10, 30)]},
    {"energy": [(0.5, 0.5)]},
    {"energy": [(0.0, 0.1), (0.9, None)]},
    {"energy": [(2.0, 1.0)]},
    {"energy": [(None, None)], "popularity": [(0, 0)]},
]


@pytest.fixture(scope="module")
def values(spark):
    rows = spark.createDataFrame(some_values(4000), VALUES)
    path = new_path(spark, "values")
    cl.save_by_values(rows, path, ["energy", "popularity"], "song_id", 64)
    return rows, path


@pytest.mark.parametrize("ranges", RANGES)
def test_rows_are_those_of_a_filter(spark, rows, values, ranges):
    table, path = values
    wanted = F.lit(True)
    for column, held in ranges.items():
        any_of = F.lit(False)
        for low, high in held:
            one = F.lit(True)
            if low is not None:
                one = one & (F.col(column) >= F.lit(low))
            if high is not None:
                one = one & (F.col(column) <= F.lit(high))
            any_of = any_of | one
        wanted = wanted & any_of
    # Not a number is not equal to itself, its text is.
    assert list(map(repr, rows(cl.read(spark, path, ranges)))) == list(map(repr, rows(table.filter(wanted))))


def test_narrow_filters_open_few_files(spark, values):
    _, path = values
    files = cl.file_bounds(spark, path).count()
    assert files > 48
    # One value alone meets about the square root of the files, both together a few.
    assert cl.files_met(spark, path, {"energy": [(0.2, 0.21)]}).count() <= files // 2
    assert cl.files_met(spark, path, {"popularity": [(95, None)]}).count() <= files // 2
    both = {"energy": [(0.2, 0.21)], "popularity": [(20, 22)]}
    assert cl.files_met(spark, path, both).count() <= files // 6
    read = cl.read(spark, path, both)
    assert len(read.inputFiles()) == cl.files_met(spark, path, both).count()


def test_a_common_value_spans_files(spark):
    path = new_path(spark, "common")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("song_id"), F.lit(0.5).alias("energy"), F.lit(1).alias("popularity"))
    cl.save_by_values(rows, path, ["energy", "popularity"], "song_id", 10)
    most = cl.file_bounds(spark, path).agg(F.max("n_rows")).first()[0]
    assert most < 600
    assert cl.read(spark, path, {"energy": [(0.5, 0.5)]}).count() == 3000


def test_empty_and_null_values(spark, rows):
    for made in ([], [("a", None, None), ("b", None, 4)]):
        path = new_path(spark, "few")
        cl.save_by_values(spark.createDataFrame(made, VALUES), path, ["energy", "popularity"], "song_id", 3)
        assert rows(cl.read(spark, path)) == sorted(made, key=repr)
        assert rows(cl.read(spark, path, {"energy": [(0, 1)]})) == []
        assert rows(cl.read(spark, path, {"popularity": [(4, 4)]})) == [r for r in made if r[2] == 4]
        assert cl.read(spark, path, {"energy": [(0, 1)]}).columns == ["song_id", "energy", "popularity"]


def test_written_anew(spark, rows):
    path = new_path(spark, "anew")
    for made in ([("a", 0.1, 1)], [("b", 0.2, 2), ("c", 0.9, 3)]):
        cl.save_by_values(spark.createDataFrame(made, VALUES), path, ["energy"], "song_id", 2)
    assert [r[0] for r in rows(cl.read(spark, path))] == ["b", "c"]
    assert [r[0] for r in rows(cl.read(spark, path, {"energy": [(0.5, None)]}))] == ["c"]


def test_range_filter_agrees(spark, rows, values):
    table, path = values
    assert rows(fl.range_filter(table, "energy", 0.0, 0.5)) == rows(cl.read(spark, path, {"energy": [(0.0, 0.5)]}))


NAMES = [
    ("1", "Red Roses"), ("2", "redemption song"), ("3", "Réd wine"), ("4", "Bored"), ("5", None), ("6", ""), ("7", "re"),
    ("8", "東京タワーの夜"), ("8", "The red \U0001f339"), (None, "infrared"), ("9", "x" * 5000 + "red"), ("4", "Bored"), ("10", "a\nred line "),
]
TEXTS = {"case": ["RED", "re", "", "タワー", "d \U0001f339", "zzz", "\nred"], "collation": ["Réd", "x" * 300, "line "]}


@pytest.mark.parametrize("fold, rare", [("case", 1), ("collation", 1), ("collation", 10**9)])
def test_names_are_those_of_a_scan(spark, rows, monkeypatch, fold, rare):
    # Both ways: lists for every text with runs, and a scan wherever a run is in any name.
    monkeypatch.setattr(ni, "RARE", rare)
    songs = spark.createDataFrame([(i, n, 1) for i, n in NAMES], "song_id string, song_name string, run int")
    path = new_path(spark, "names")
    ni.save_names(songs, path, fold)
    key = ni.FOLDS[fold]
    for text in TEXTS[fold]:
        wanted = songs.filter(F.contains(key(F.col("song_name")), key(F.lit(text))))
        assert rows(ni.songs_containing(spark, path, text)) == rows(wanted), text


def test_many_candidates_are_joined_by_shuffle(spark, rows, monkeypatch):
    monkeypatch.setattr(ni, "SMALL_IDS", 0)
    monkeypatch.setattr(ni, "RARE", 1)
    songs = spark.createDataFrame(NAMES, "song_id string, song_name string")
    path = new_path(spark, "names")
    ni.save_names(songs, path)
    wanted = songs.filter(F.contains(F.lower("song_name"), F.lit("red")))
    assert rows(ni.songs_containing(spark, path, "red")) == rows(wanted)


def test_a_rare_part_reads_few_buckets(spark):
    songs = spark.range(5000).select(
        F.col("id").cast("string").alias("song_id"), F.concat(F.lit("common name "), F.md5(F.col("id").cast("string"))).alias("song_name")
    )
    path = new_path(spark, "names")
    ni.save_names(songs, path)
    one = songs.filter("song_id = '77'").first().song_name
    found = ni.songs_containing(spark, path, one[12:30].upper())
    assert [r.song_id for r in found.collect()] == ["77"]
    assert len(found.inputFiles()) < len(ni.bt.read(spark, f"{path}/songs").inputFiles())


def test_no_songs(spark):
    path = new_path(spark, "none")
    ni.save_names(spark.createDataFrame([], "song_id string, song_name string"), path)
    for text in ("red", "r", ""):
        assert ni.songs_containing(spark, path, text).collect() == []
