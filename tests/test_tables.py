"""Table changes, playlists, audit, dumps."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cadenza.operators import audit, mutations as mu, playlists as pl
from cadenza.sources import tables as tb

EARLY, NOW = datetime(2020, 1, 1), datetime(2024, 5, 6)
LINKS = "song_id string, spotify_url string, youtube_music_url string"


def test_upsert_embeddings(spark, rows):
    schema = "song_id string, embedding array<float>, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([("a", [1.0], EARLY, EARLY), ("b", [2.0], EARLY, EARLY), ("c", [3.0], EARLY, EARLY)], schema)
    new = spark.createDataFrame([("a", None), ("b", [2.0]), ("d", [4.0])], "song_id string, embedding array<float>")
    assert rows(mu.upsert_embeddings(old, new, NOW)) == [
        ("a", None, EARLY, NOW),
        ("b", [2.0], EARLY, EARLY),
        ("c", [3.0], EARLY, EARLY),
        ("d", [4.0], NOW, NOW),
    ]
    kept = mu.upsert_embeddings(old, new, NOW, keep_existing=True)
    assert rows(kept)[0] == ("a", [1.0], EARLY, EARLY)
    once = mu.upsert_embeddings(old, new, NOW)
    assert rows(mu.upsert_embeddings(once, new, NOW)) == rows(once)


def test_upsert_embeddings_takes_the_last_of_several(spark, rows):
    old = spark.createDataFrame([("a", [1.0])], "song_id string, embedding array<float>")
    new = spark.createDataFrame([(1, "a", [3.0]), (2, "a", [2.0]), (3, "b", None)], "seq long, song_id string, embedding array<float>")
    assert rows(mu.upsert_embeddings(old, new)) == [("a", [2.0]), ("b", None)]
    assert rows(mu.upsert_embeddings(old, new.drop("seq"))) == [("a", [2.0]), ("b", None)]


def test_upsert_links(spark, rows):
    old = spark.createDataFrame([("a", "x", "z"), ("b", "x", None)], LINKS)
    new = spark.createDataFrame([("a", None, "y"), ("c", None, None), ("d", "n", None), ("b", None, None)], LINKS)
    assert rows(mu.upsert_links(old, new)) == [("a", "x", "y"), ("b", "x", None), ("d", "n", None)]
    assert rows(mu.upsert_links(old, new, keep_empty=True)) == [
        ("a", "x", "y"), ("b", "x", None), ("c", None, None), ("d", "n", None),
    ]
    once = mu.upsert_links(old, new)
    assert rows(mu.upsert_links(once, new)) == rows(once)


def test_upsert_links_times_and_order(spark, rows):
    old = spark.createDataFrame(
        [("a", "x", None, "apple", EARLY, EARLY), ("b", "x", None, None, EARLY, EARLY)], tb.SCHEMAS["song_links"]
    )
    new = spark.createDataFrame([(1, "a", "u1", "v1"), (2, "a", "u0", None)], "seq long, " + LINKS)
    got = mu.upsert_links(old, new, run_at=NOW)
    assert rows(got) == [("a", "u0", "v1", "apple", EARLY, NOW), ("b", "x", None, None, EARLY, EARLY)]


def test_patch_links(spark, rows):
    links = spark.createDataFrame([("a", None, "y"), ("b", "x", None)], LINKS)
    patch = spark.createDataFrame(
        [("a", "spotify_url", "s"), ("b", "youtube_music_url", "t"), ("zz", "spotify_url", "s")],
        "song_id string, link_column string, link_value string",
    )
    assert rows(mu.patch_links(links, patch)) == [("a", "s", "y"), ("b", "x", "t")]


def test_a_patch_refreshes_the_time_of_rows_that_change(spark, rows):
    data = [("a", "s", None, "apple", EARLY, EARLY), ("b", "x", None, None, EARLY, EARLY), ("c", "x", None, None, EARLY, EARLY)]
    links = spark.createDataFrame(data, tb.SCHEMAS["song_links"])
    patch = spark.createDataFrame([("a", "spotify_url", "s"), ("b", "spotify_url", "new")], "song_id string, link_column string, link_value string")
    assert rows(mu.patch_links(links, patch, NOW)) == [
        ("a", "s", None, "apple", EARLY, EARLY), ("b", "new", None, None, EARLY, NOW), ("c", "x", None, None, EARLY, EARLY),
    ]
    with pytest.raises(Exception, match="names no link column: apple"):
        mu.patch_links(links, patch.withColumn("link_column", F.lit("apple"))).collect()


def test_coverage_of_the_published_run(spark):
    n = 20405
    links = spark.range(n).selectExpr(
        "id AS song_id", "if(id < 9, null, 'u') AS spotify_url", "if(id < 7, null, 'v') AS youtube_music_url"
    )
    assert tuple(audit.link_coverage(links).first()) == (n, 9, 0.04, n - 9, 99.96, 7, 0.03, n - 7, 99.97)


def test_coverage_of_an_empty_table(spark):
    row = audit.link_coverage(spark.createDataFrame([], LINKS)).first()
    assert row.total == 0 and row.sp_null_pct is None and row.yt_not_null_pct is None


def test_inspection_limits(spark, rows):
    songs = spark.createDataFrame([("1", "Thank you", "x"), ("2", "thankful", "y"), ("3", "No", "z")], "song_id string, song_name string, artists string")
    vectors = spark.createDataFrame([("1", [1.0, 2.0, 3.0, 4.0])], "song_id string, embedding array<float>")
    assert rows(audit.embedding_preview(songs, vectors, "Thank")) == [
        ("1", "Thank you", "x", [1.0, 2.0, 3.0], "[1.0,2.0,3.0,4.0]"), ("2", "thankful", "y", None, None),
    ]
    assert audit.embedding_preview(songs, vectors, "thank", limit=1).count() == 1


PLAYLISTS = "id long, user_id string, playlist_name string, song_data string"


@pytest.fixture(scope="module")
def playlists(spark):
    return spark.createDataFrame(
        [
            (5, "u", "p", '{"t": 2}'), (1, "u", "p", '{"t": 1}'), (2, "u", "p", ""), (3, "u", "empty", ""),
            (4, "u", "bad", "{oops"), (9, "v", "p", '{"t": 3}'),
        ],
        PLAYLISTS,
    )


def test_playlists_by_user(playlists, rows):
    got = rows(pl.playlists_by_user(playlists, "u"))
    assert got == [
        ("u", "bad", 0, None, True), ("u", "empty", None, None, False),
        ("u", "p", 0, '{"t": 1}', False), ("u", "p", 1, '{"t": 2}', False),
    ]
    assert pl.playlists_by_user(playlists).count() == 5


def test_playlist_pages(spark, rows):
    data = [(i, "u", "p", f"{i}") for i in range(25)] + [(99, "u", "e", ""), (100, "u", "bad", "{"), (101, "u", "p", "no json")]
    pages = rows(pl.playlist_pages(spark.createDataFrame(data, PLAYLISTS), page=10))
    assert pages == [
        ("u", "bad", 0, [], 1), ("u", "e", 0, [], 0), ("u", "p", 0, [str(i) for i in range(10)], 0),
        ("u", "p", 1, [str(i) for i in range(10, 20)], 0), ("u", "p", 2, [str(i) for i in range(20, 25)], 1),
    ]


def test_replace_and_delete(playlists, rows):
    replaced = rows(pl.replace_playlist(playlists, "u", "p", ["a", "b"]))
    assert [r for r in replaced if r[2] == "p" and r[1] == "u"] == [(10, "u", "p", "a"), (11, "u", "p", "b")]
    deleted = rows(pl.delete_playlist(playlists, "u", "p"))
    assert rows(pl.replace_playlist(playlists, "u", "p", [])) == deleted
    assert rows(pl.delete_playlist(playlists, "nobody", "p")) == rows(playlists)


def test_last_command_wins(spark, playlists, rows):
    commands = spark.createDataFrame(
        [
            (1, "replace", "u", "p", ["old"]), (2, "delete", "u", "p", None), (3, "delete", "v", "p", None),
            (7, "replace", "v", "p", ["x", "y"]), (5, "replace", "w", "new", ["z"]),
        ],
        "seq long, op string, user_id string, playlist_name string, songs array<string>",
    )
    for hot_rows in (1, 1_000_000):
        got = rows(pl.apply_playlist_commands(playlists, commands, hot_rows))
        assert [r for r in got if r[1] != "u"] == [(10, "w", "new", "z"), (11, "v", "p", "x"), (12, "v", "p", "y")]
        assert not [r for r in got if r[1:3] == ("u", "p")]


def test_commands_keep_the_times_of_other_rows(spark, rows):
    old = spark.createDataFrame([(1, "u", "p", "a", EARLY, EARLY)], tb.SCHEMAS["user_playlists"])
    command = spark.createDataFrame(
        [(1, "replace", "v", "p", ["b"])], "seq long, op string, user_id string, playlist_name string, songs array<string>"
    )
    got = pl.apply_playlist_commands(old, command, run_at=NOW)
    assert rows(got) == [(1, "u", "p", "a", EARLY, EARLY), (2, "v", "p", "b", NOW, NOW)]


def test_dump_and_restore(spark, rows, tmp_path):
    links = spark.createDataFrame([("a", "x", None, None, EARLY, NOW)], tb.SCHEMAS["song_links"])
    tb.dump_table(links, str(tmp_path / "whole"))
    back = tb.restore_table(spark, str(tmp_path / "whole"))
    assert rows(back) == rows(links) and back.schema == links.schema
    tb.dump_table(links, str(tmp_path / "structure"), data=False)
    empty = tb.restore_table(spark, str(tmp_path / "structure"))
    assert empty.count() == 0 and empty.schema == links.schema


def test_clustered_rows_of_a_common_user_span_files(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    data = [(i, "hot" if i % 3 else f"u{i}", "p", "{}") for i in range(900)]
    lists = spark.createDataFrame(data, PLAYLISTS)
    tb.write_clustered(lists, str(tmp_path / "p"), ["user_id", "playlist_name", "id"], 6)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert rows(back) == rows(lists)
    by_file = back.filter("user_id = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(by_file) > 2 and max(r["count"] for r in by_file) < 400


def test_ensure_table(spark, rows, tmp_path):
    path = str(tmp_path / "embeddings")
    empty = tb.ensure_table(spark, "embeddings", "t_embeddings", path)
    assert empty.count() == 0 and empty.columns == ["song_id", "embedding", "created_at", "updated_at"]
    new = spark.createDataFrame([("a", [1.0])], "song_id string, embedding array<float>")
    mu.upsert_embeddings(empty, new, NOW).write.mode("append").insertInto("t_embeddings")
    assert rows(tb.ensure_table(spark, "embeddings", "t_embeddings", path)) == [("a", [1.0], NOW, NOW)]


def test_listing(spark):
    spark.createDataFrame([(1, "x")], "id int, name string").createOrReplaceTempView("listed_table")
    assert tb.list_tables(spark, "listed%").count() == 1
    assert [r.col_name for r in tb.describe_table(spark, "listed_table").collect()] == ["id", "name"]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(song_id")


def test_small_changes_leave_the_table_where_it_is(spark, rows, monkeypatch):
    shape = "song_id string, spotify_url string, youtube_music_url string"
    links = spark.range(3000).selectExpr("cast(id AS string) AS song_id", "'s' AS spotify_url", "cast(null AS string) AS youtube_music_url")
    links = links.unionByName(spark.createDataFrame([(None, "n", None)] * 2, shape))
    new = spark.createDataFrame([("7", None, "y"), ("x", "n", None), (None, "m", None), ("7", "t", None)], shape)
    patch = spark.createDataFrame([("9", "spotify_url", "p"), (None, "spotify_url", "q")], "song_id string, link_column string, link_value string")
    vectors = spark.range(500).selectExpr("cast(id AS string) AS song_id", "array(1.0f) AS embedding")
    fresh = spark.createDataFrame([("3", [2.0]), ("x", None), (None, [4.0])], "song_id string, embedding array<float>")
    changes = [lambda: mu.upsert_links(links, new), lambda: mu.patch_links(links, patch), lambda: mu.upsert_embeddings(vectors, fresh)]
    small = [change() for change in changes]
    assert [exchanges(df) for df in small] == [0, 0, 0]
    by_broadcast = [rows(df) for df in small]
    monkeypatch.setattr(mu, "SMALL_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = [change() for change in changes]
        assert all(exchanges(df) for df in large)
        assert [rows(df) for df in large] == by_broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
