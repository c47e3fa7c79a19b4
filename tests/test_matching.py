import pytest
from pyspark.sql import functions as F

from cadenza.operators import link_run as lr, matching as mt

CANDIDATES = (
    "song_id string, strategy_no int, pos int, title string, artists array<string>, album string, "
    "result_type string, url string"
)


def songs(spark, *data):
    return spark.createDataFrame(list(data), "song_id string, song_name string, artist string, album string, skipped boolean")


def offers(spark, *data):
    return spark.createDataFrame(list(data), CANDIDATES)


def best(spark, rules, song, *candidates):
    row = mt.match_links(songs(spark, song), offers(spark, *candidates), rules).first()
    address = "https://music.youtube.com/watch?v="
    assert row.url is None or row.url.startswith(address) == rules.gives_ids
    return (row.url and row.url.removeprefix(address), row.tier)


ONE = ("1", "Blue", "Ann", "Sky", False)


@pytest.mark.parametrize(
    "rules, candidates, expected",
    [
        # The exact name with artist and album beats an earlier partial one.
        (mt.SERVICE_A, [("1", 1, 0, "Blue (Live)", ["Ann"], "Sky", "song", "u0"), ("1", 1, 1, " blue ", ["ANN B"], "sky high", "song", "u1")], ("u1", 1)),
        (mt.SERVICE_A, [("1", 1, 0, "Blue (Live)", ["Ann"], "Sky", "song", "u0"), ("1", 1, 1, "Red", ["Ann"], "Sky", "song", "u1")], ("u0", 2)),
        # Without the album, the earliest of exact and partial names wins.
        (mt.SERVICE_A, [("1", 1, 0, "Blue x", ["Ann"], "Sea", "song", "u0"), ("1", 1, 1, "Blue", ["Ann"], "Sea", "song", "u1")], ("u0", 3)),
        # Nothing fits: the first result.
        (mt.SERVICE_A, [("1", 1, 0, "Red", ["Ann"], "Sky", "song", "u0"), ("1", 1, 1, "Blue", ["Bob"], "Sky", "song", "u1")], ("u0", 9)),
        # A missing candidate album passes for A and fails for B.
        (mt.SERVICE_A, [("1", 1, 0, "Blue", ["Ann"], None, "song", "u0")], ("u0", 1)),
        (mt.SERVICE_B, [("1", 1, 0, "Blue", ["Ann"], None, "song", "u0")], ("u0", 3)),
        # B matches songs only, but falls back to any type.
        (mt.SERVICE_B, [("1", 1, 0, "Blue", ["Ann"], "Sky", "video", "u0"), ("1", 1, 1, "Blue", ["Ann"], "Sky", "song", "u1")], ("u1", 1)),
        (mt.SERVICE_B, [("1", 1, 0, "Blue", ["Ann"], "Sky", "video", "u0")], ("u0", 9)),
        (mt.SERVICE_B, [("1", 1, 0, "Blue", None, "Sky", "song", "u0")], ("u0", 9)),
        # The first strategy with results counts, even with a fallback only.
        (mt.SERVICE_A, [("1", 1, 0, "Red", ["Bob"], "", "song", "u0"), ("1", 2, 0, "Blue", ["Ann"], "Sky", "song", "u1")], ("u0", 9)),
        # The older variant knows no albums and does not prefer exact names.
        (mt.SERVICE_A_SIMPLE, [("1", 1, 0, "Blue x", ["Ann"], None, "video", "u0"), ("1", 1, 1, "Blue", ["Ann"], None, "song", "u1")], ("u0", 1)),
        (mt.SERVICE_B_SIMPLE, [("1", 1, 0, "Blue x", ["Ann"], None, "video", "u0"), ("1", 1, 1, "Blue", ["Ann"], None, "song", "u1")], ("u1", 1)),
        (mt.SERVICE_A, [], (None, None)),
    ],
)
def test_best_candidate(spark, rules, candidates, expected):
    assert best(spark, rules, ONE, *candidates) == expected


def test_empty_artist_and_album_match_anything(spark):
    offer = ("1", 1, 0, "Blue", [], None, "song", "u")
    for artist, album in ((None, None), ("", ""), ("  ", None)):
        assert best(spark, mt.SERVICE_B, ("1", "Blue", artist, album, False), offer) == ("u", 1)


def test_song_on_several_albums_keeps_the_best_tier(spark):
    rows = [("1", "Blue", "Ann", album, False) for album in ("Sea", "Sky")]
    offer = offers(spark, ("1", 1, 0, "Blue", ["Ann"], "Sky", "song", "u"))
    assert [tuple(r)[:4] for r in mt.match_links(songs(spark, *rows), offer, mt.SERVICE_A).collect()] == [("1", "A", "u", 1)]


def test_hot_song_gives_the_same_match(spark, rows):
    data = [("1", 1, i, f"Red {i}", ["Ann"], "Sky", "song", f"u{i}") for i in range(200)]
    data += [("1", 1, 500, "Blue", ["Ann"], "Sky", "song", "right"), ("2", 1, 0, "x", [], None, "song", "two")]
    some = songs(spark, ONE, ("2", "Blue", None, None, False))
    plain = mt.match_links(some, offers(spark, *data), mt.SERVICE_A)
    split = mt.match_links(some, offers(spark, *data), mt.SERVICE_A, hot_rows=10)
    assert rows(plain) == rows(split)
    assert rows(split.select("song_id", "url")) == [("1", "right"), ("2", "two")]


RAW = [
    ("1", "Blue", "{'a': 'Ann (feat. Bob)'}", " Sky "),
    ("2", None, "x", None),
    ("3", "", "x", None),
    ("4", "None", "x", None),
    ("5", "NONE", "x", None),
    ("6", "Red", "none", "None"),
    ("7", "Grey", None, "Sky"),
    ("8", "Pink", "Ann", None),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    return mt.clean_input(spark.createDataFrame(RAW, "song_id string, song_name string, artists string, album_name string"))


def test_clean_input(cleaned):
    got = {r.song_id: r for r in cleaned.collect()}
    assert (got["1"].artist, got["1"].album) == ("Ann", "Sky")
    assert [i for i, r in sorted(got.items()) if r.skipped] == ["2", "3", "4"]


def test_search_texts(cleaned):
    got = {(r.song_id, r.service, r.strategy_no): r.query for r in mt.search_texts(cleaned).collect()}
    assert got[("1", "A", 1)] == 'track:"Blue" artist:"Ann" album:"Sky"'
    assert got[("1", "A", 2)] == got[("1", "B", 1)] == "Blue Ann Sky"
    assert got[("6", "A", 1)] == 'track:"Red"' and got[("6", "A", 2)] == "Red"
    assert got[("7", "A", 1)] == 'track:"Grey" album:"Sky"'
    assert got[("8", "A", 2)] == "Pink Ann"
    assert {k[0] for k in got} == {"1", "6", "7", "8"}


def test_the_simple_job_skips_nothing(spark):
    raw = spark.createDataFrame(RAW, "song_id string, song_name string, artists string, album_name string")
    simple = mt.clean_input(raw, simple=True)
    assert simple.filter("skipped").count() == 0
    got = {(r.song_id, r.strategy_no): r.query for r in mt.search_texts(simple, skips_none=False).filter("service = 'A'").collect()}
    assert got[("6", 1)] == 'track:"Red" artist:"none"' and got[("5", 2)] == "NONE x" and ("2", 1) not in got
    found = offers(spark, ("3", 1, 0, "Any", ["x"], None, "song", "u3"), ("5", 1, 0, "none", ["x"], None, "song", "u5"))
    urls = {r.song_id: r.url for r in mt.match_links(simple, found, mt.SERVICE_A_SIMPLE).collect()}
    assert urls["3"] == "u3" and urls["5"] == "u5" and urls["2"] is None and len(urls) == len(RAW)


def test_candidates_of_the_other_service_are_ignored(spark):
    offer = offers(spark, ("1", 1, 0, "Blue", ["Ann"], "Sky", "song", "a"), ("1", 1, 1, "Blue", ["Ann"], "Sky", "song", "b"))
    offer = offer.withColumn("service", F.upper("url"))
    some = songs(spark, ONE)
    assert [mt.match_links(some, offer, r).first().url for r in (mt.SERVICE_A, mt.SERVICE_B)] == [
        "a", "https://music.youtube.com/watch?v=b"
    ]


def test_every_album_is_matched_by_its_own_candidates(spark, rows):
    some = songs(spark, *[("1", "Blue", "Ann", album, False) for album in ("Sea", "Sky", None, None)])
    found = offers(
        spark, ("1", 1, 0, "Blue", ["Ann"], "Sea", "song", "sea"), ("1", 1, 1, "Blue", ["Ann"], "Sky", "song", "sky"),
        ("1", 1, 2, "Red", ["Bob"], None, "song", "other"),
    ).withColumn("searched_album", F.when(F.col("url") != "other", F.initcap("url")))
    links = mt.match_links(some, found.filter("url != 'sky'"), mt.SERVICE_A)
    assert [tuple(r)[:5] for r in links.orderBy("album_key").collect()] == [
        ("1", "", "A", "other", 9), ("1", "Sea", "A", "sea", 1), ("1", "Sky", "A", None, None),
    ]
    # Counted in rows of the input: two of them have no album.
    assert rows(mt.link_summary(some, links)) == [("A", 4, 4, 0, 1, 3)]
    assert rows(mt.link_failures(some, links).select("song_id", "album")) == [("1", "Sky")]
    assert rows(mt.link_updates(links)) == [("1", "sea", None)]


def test_summary_counts_rows_where_songs_repeat(spark, rows):
    some = songs(spark, *[("1", "Blue", "Ann", album, False) for album in ("a", "b", "c")])
    links = mt.match_links(some, offers(spark), mt.SERVICE_A)
    assert mt.link_failures(some, links).count() == 3
    assert rows(mt.link_summary(some, links)) == [("A", 3, 3, 0, 3, 0)]


def test_failures_and_summary(spark, cleaned, rows):
    found = offers(spark, ("1", 1, 0, "Blue", ["Ann"], "Sky", "song", "u"), ("5", 1, 0, "NONE", [], None, "song", "u5"))
    links = mt.match_links(cleaned, found, mt.SERVICE_A)
    failed = rows(mt.link_failures(cleaned, links).select("song_id", "service"))
    # A name that is 'none' in another case is read but never searched.
    assert failed == [("5", "A"), ("6", "A"), ("7", "A"), ("8", "A")]
    assert rows(mt.link_summary(cleaned, links)) == [("A", 8, 5, 0, 4, 1)]


def test_watch_address(spark):
    row = spark.createDataFrame([("abc",)], "v string").select(mt.watch_address(F.col("v"))).first()
    assert row[0] == "https://music.youtube.com/watch?v=abc"


def test_a_run_counts_while_it_writes(spark, rows):
    cleaned = spark.createDataFrame(
        [("1", "Song", "x", None, False), ("1", "Song", "x", None, False), ("2", "Other", None, None, False), ("3", "None", None, None, True),
         ("a song id of more than 22 characters", "Song", None, None, False)],
        "song_id string, song_name string, artist string, album string, skipped boolean",
    )
    offers = spark.createDataFrame(
        [(i, 1, 0, "Song", ["x"], "", "song", f"video-{i[:1]}") for i in ("1", "a song id of more than 22 characters")],
        "song_id string, strategy_no int, pos int, title string, artists array<string>, album string, result_type string, url string",
    )
    both = (mt.SERVICE_A, mt.SERVICE_B)
    run = lr.run_links(cleaned, offers, both)
    # Two equal rows are two; song 2 has no candidates; the long id fails for both services.
    assert rows(run.figures) == [("A", 5, 3, 1, 1, 2), ("B", 5, 3, 1, 1, 2)]
    assert rows(run.failures().select("song_id", "service")) == [("2", "A"), ("2", "B")]
    assert {r.song_id: r.spotify_url for r in run.updates().collect()} == {"1": "video-1", "2": None}
    plan = run.failures()._jdf.queryExecution().toString() + run.updates()._jdf.queryExecution().toString()
    assert "plain_title" not in plan
    # An address of service B that does not fit keeps the one of service A out as well.
    narrow = lr.run_links(cleaned, offers, both, lr.Widths(url=10))
    assert rows(narrow.figures) == [("A", 5, 1, 3, 1, 0), ("B", 5, 1, 3, 1, 0)]
    assert rows(mt.link_summary(cleaned, run.links).select("service", "failed_fetches")) == [("A", 1), ("B", 1)]


def test_without_popular_songs_candidates_are_shuffled_once(spark, rows):
    some = songs(spark, *[(str(i % 4), "Blue", "Ann", ["Sky", "Sea"][i % 2], False) for i in range(6)], ("9", "Red", None, None, False))
    data = [(str(i % 5), 1, i, ["Blue", "Blue x", "Red"][i % 3], ["Ann"], ["Sky", "Sea"][i % 2], ["song", "video"][i % 2], f"u{i}") for i in range(60)]
    services = (mt.SERVICE_A, mt.SERVICE_B)
    whole = mt.match_links(some, offers(spark, *data), services)
    # Candidates, names, albums and songs come to their song once, the latter three made different before.
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 7 and "__salt" not in plan
    split = mt.match_links(some, offers(spark, *data), services, hot_rows=3)
    assert rows(whole) == rows(split) and len(rows(whole)) == 10
