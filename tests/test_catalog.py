import pytest

from cadenza.operators import catalog as ct, index as ix, matching as mt


@pytest.fixture(scope="module")
def tables(spark):
    def df(data, schema):
        return spark.createDataFrame(data, schema)

    return {
        "songs": df(
            [
                ("Aa", "One", "{'r1': 'X'}", 5, "solo"),
                ("b", "Two", "{'r9': 'Y'}", None, "solo"),
                ("c", "Three", None, 7, "solo"),
                ("d", "Four", "r1", 1, "solo"),
                ("", "Empty", "r1", 1, "solo"),
                ("e", "Zero", "r1", 1, "solo"),
            ],
            "song_id string, song_name string, artists string, popularity int, song_type string",
        ),
        "lyrics": df([("aA", "la la"), ("b", "l2"), ("b", "l1"), ("c", None)], "song_id string, lyrics string"),
        "embeddings": df(
            [("Aa", "[1.0, 0.0]"), ("b", "null"), ("b", "[0, 1]"), ("c", ""), ("d", "[1]"), ("", "[1, 1]"), ("e", "[0, 0]")],
            "song_id string, embedding string",
        ),
        "links": df([("Aa", "u2"), ("Aa", "u1")], "song_id string, spotify_url string"),
        "features": df([("Aa", 0.5), ("b", None)], "song_id string, energy float"),
        "artists": df(
            [("r1", "The X", "band", "pop", "[]", None)],
            "artist_id string, name string, artist_type string, main_genre string, genres string, image_url string",
        ),
    }


def test_catalog_fans_out_and_ignores_case_of_lyrics_only(tables, rows):
    got = ct.build_catalog(tables)
    assert got.filter("song_id = 'Aa'").count() == 2
    assert got.filter("song_id = 'b'").count() == 4
    assert {r.lyrics for r in got.filter("song_id = 'Aa'").collect()} == {"la la"}
    exact = ct.build_catalog(tables, ignore_case=False)
    assert {r.lyrics for r in exact.filter("song_id = 'Aa'").collect()} == {None}


def test_accepted_and_rejected_make_up_the_input(tables, rows):
    catalog = ct.build_catalog(tables)
    accepted = ct.accepted_documents(catalog, 2).count()
    rejected = rows(ct.rejected_documents(tables, 2))
    assert rejected == [
        ("", "empty_song_id", 1), ("b", "missing_embedding", 2), ("c", "missing_embedding", 1),
        ("d", "bad_dims", 1), ("e", "zero_norm", 1),
    ]
    assert accepted + sum(n for _, _, n in rejected) == catalog.count()
    summary = {(r.status, r.reason): r.n_rows for r in ct.index_summary(tables, 2).collect()}
    assert summary[("indexed", "")] == accepted
    assert sum(summary.values()) == catalog.count()


def test_outcomes_equal_those_of_the_fanned_out_rows(tables, rows):
    checked = ct.check_documents(ct.build_catalog(tables), 2)
    assert rows(ct.index_outcomes(tables, 2)) == rows(checked.groupBy("song_id", "reason").count())


def test_hot_ids_are_joined_like_any_other(tables, rows):
    plain = ct.build_catalog(tables)
    assert rows(ct.build_catalog(tables, hot_rows=1)) == rows(plain)


def test_one_document_per_song(tables):
    docs = {r.song_id: r for r in ct.build_documents(tables, 2).collect()}
    assert set(docs) == {"Aa", "b"}
    assert (docs["Aa"].spotify_url, docs["Aa"].name_artists, docs["Aa"].energy) == ("u1", "The X", 0.5)
    assert (docs["b"].lyrics, docs["b"].embedding, docs["b"].name_artists) == ("l1", [0.0, 1.0], None)


def test_numbers_given_as_text(spark, tables):
    songs = spark.createDataFrame(
        [("Aa", "One", None, "7", "solo"), ("b", "Two", None, "many", "solo")],
        "song_id string, song_name string, artists string, popularity string, song_type string",
    )
    features = spark.createDataFrame([("Aa", "0.25"), ("b", "x")], "song_id string, energy string")
    docs = {r.song_id: r for r in ct.build_documents({**tables, "songs": songs, "features": features}, 2).collect()}
    assert (docs["Aa"].popularity, docs["Aa"].energy) == (7, 0.25)
    assert (docs["b"].popularity, docs["b"].energy) == (None, None)


def test_hot_artist_is_joined_like_any_other(tables, rows):
    plain = ct.join_artist(tables["songs"], tables["artists"])
    split = ct.join_artist(tables["songs"], tables["artists"], hot_rows=1)
    assert rows(plain) == rows(split.select(plain.columns))


def test_field_statistics_count_only_documents_with_words(spark, rows):
    docs = spark.createDataFrame(
        [("1", "red rose", None, "red red"), ("2", "", "The X", None)],
        "song_id string, song_name string, name_artists string, lyrics string",
    )
    index = ix.build_index(docs)
    assert rows(index.fields) == [("lyrics", 1, 2, 2.0), ("name_artists", 1, 2, 2.0), ("song_name", 1, 2, 2.0)]
    assert rows(index.postings.filter("field = 'lyrics'").select("song_id", "term", "tf", "dl")) == [("1", "red", 2, 2)]
    assert rows(index.terms.filter("term = 'red'")) == [("lyrics", "red", 1), ("song_name", "red", 1)]


def test_match_input_keeps_the_fan_out(spark, rows):
    songs = spark.createDataFrame([("1", "A", "x"), ("2", "B", "y")], "song_id string, song_name string, artists string")
    tracks = spark.createDataFrame([("1", "p"), ("1", "q"), ("3", "p")], "song_id string, album_id string")
    albums = spark.createDataFrame([("p", "Pop")], "album_id string, name string")
    expected = [("1", "A", "x", "Pop"), ("1", "A", "x", None), ("2", "B", "y", None)]
    assert rows(mt.match_input(songs, tracks, albums)) == expected
    assert rows(mt.match_input(songs, tracks, albums, hot_rows=1)) == expected
    assert [r.song_id for r in mt.match_input(songs, tracks, albums, limit=2).collect()] == ["1", "1"]


def many_songs(spark, tables, n=300):
    """Some songs without a vector, ids that differ in case only, and long lyrics."""
    songs = [(f"Id{i % 250}", f"Name {i}", "r1", i, "solo") for i in range(n)]
    lyrics = [(f"iD{i}" if i % 2 else f"Id{i} ", f"{i % 7} " * 500) for i in range(n)] * 2
    vectors = [(f"Id{i}", "[1, 1]" if i % 4 else "[0, 0]") for i in range(0, n, 3)] + [(None, "[1, 1]")]
    return tables | {
        "songs": spark.createDataFrame(songs, tables["songs"].schema),
        "lyrics": spark.createDataFrame([*lyrics, (None, "none")], tables["lyrics"].schema),
        "embeddings": spark.createDataFrame(vectors, tables["embeddings"].schema),
    }


@pytest.mark.parametrize("ignore_case", [True, False])
def test_documents_are_the_accepted_rows_of_the_whole_catalogue(spark, tables, rows, monkeypatch, ignore_case):
    many = many_songs(spark, tables)
    # In this data rows of one id differ in song_name and popularity only, which grow together, and in their vectors not.
    whole = {}
    for r in ct.accepted_documents(ct.build_catalog(many, ignore_case=ignore_case), 2).collect():
        whole[r.song_id] = min(whole.get(r.song_id, r), r, key=lambda x: x.song_name)
    found = rows(ct.build_documents(many, 2, ignore_case))
    assert len(found) > 50 and found == sorted(map(tuple, whole.values()), key=repr)
    # Too many ids to be sent give the same.
    monkeypatch.setattr(ct, "SMALL_ROWS", 10)
    assert rows(ct.build_documents(many, 2, ignore_case)) == found


def test_lyrics_are_shuffled_once(spark, tables, monkeypatch):
    many = many_songs(spark, tables)

    def shuffles():
        plan = ct.build_documents(many, 2)._jdf.queryExecution().executedPlan()
        leaves = str(plan.toString()).splitlines()
        at = next(i for i, line in enumerate(leaves) if "Scan ExistingRDD[song_id" in line and "lyrics" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
        # The operators above the scan of lyrics, up to the join that they meet the songs in.
        above, now = [], depth(leaves[at])
        for line in reversed(leaves[:at]):
            if depth(line) < now:
                now = depth(line)
                if "LeftOuter" in line:
                    break
                above.append(line)
        return sum("Exchange hashpartitioning" in line for line in above), any("LeftSemi" in line for line in above)

    # Also where songs without a vector are not left out before.
    assert shuffles() == (1, True)
    monkeypatch.setattr(ct, "SMALL_ROWS", 10)
    assert shuffles() == (1, False)
