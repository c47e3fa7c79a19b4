"""Registered queries of the catalogue and the index build, with their oracle texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.artists import clean_artist, first_artist, first_artist_simple
from cadenza.functions.text import first_quoted, words
from cadenza.operators import audit, catalog as ct, filters as fl, index as ix
from cadenza.plans import inputs
from cadenza.sources import clustered, name_index
from cadenza.sources.catalog_views import BASE_TABLES, base_table, view, with_views

SHOWN = (
    "song_id song_name lyrics popularity song_type artist_id name_artists artist_type "
    "main_genre genres image_url spotify_url energy"
).split()

CATALOG_VIEWS = "songs lyrics song_embeddings song_links artists acoustic_features"

# The first quoted token, written for the oracle.
TOKEN = "trim(CASE WHEN contains(s.artists, '''') THEN split_part(s.artists, '''', 2) ELSE s.artists END, '''')"

CATALOG_CTE = f"""named AS (
    SELECT s.song_id, s.song_name, s.artists AS s_artists, s.popularity, s.song_type, a.artist_id,
           a.name AS name_artists, a.artist_type, a.main_genre, a.genres, a.image_url
    FROM songs s LEFT JOIN artists a ON a.artist_id = {TOKEN}),
  sung AS (SELECT n.*, l.lyrics FROM named n LEFT JOIN lyrics l ON lower(l.song_id) = lower(n.song_id)),
  catalog AS (
    SELECT sung.*, spotify_url, embedding, energy FROM sung
    LEFT JOIN song_links USING (song_id)
    LEFT JOIN song_embeddings USING (song_id)
    LEFT JOIN acoustic_features USING (song_id))"""

REASON = f"""CASE WHEN embedding IS NULL THEN 'missing_embedding'
    WHEN song_id IS NULL OR song_id = '' THEN 'empty_song_id'
    WHEN len(embedding) <> {inputs.DIMS} THEN 'bad_dims'
    WHEN list_dot_product(embedding, embedding) = 0 THEN 'zero_norm' END"""

DOCS_CTE = f"""{CATALOG_CTE},
  checked AS (SELECT *, {REASON} AS reason FROM catalog),
  docs AS (SELECT * FROM checked WHERE reason IS NULL)"""

def _word_sql() -> str:
    """A call that cuts {0} into words, in the oracle's dialect of regular expressions."""
    kana = r"\p{Katakana}\x{3031}-\x{3035}\x{309b}\x{309c}\x{30a0}\x{30fc}\x{ff70}"
    letter = rf"(?:[^\P{{L}}\p{{Han}}\p{{Hiragana}}{kana}\p{{Thai}}\p{{Lao}}\p{{Myanmar}}\p{{Khmer}}]|[^\P{{Nl}}\p{{Han}}])"
    mark = r"[\p{M}\p{Cf}]"
    alpha = rf"{letter}(?:{letter}|{mark})*(?:[.''\x{{2018}}\x{{2019}}:\x{{b7}}]{letter}(?:{letter}|{mark})*)*"
    number = rf"\p{{Nd}}(?:\p{{Nd}}|{mark})*(?:[.''\x{{2018}}\x{{2019}},;]\p{{Nd}}(?:\p{{Nd}}|{mark})*)*"
    joined = rf"\p{{Pc}}*(?:{alpha}|{number})(?:\p{{Pc}}*(?:{alpha}|{number}))*\p{{Pc}}*"
    runs = rf"[{kana}](?:[{kana}]|{mark})*|[\x{{e01}}-\x{{e3a}}\x{{e40}}-\x{{e4e}}]+"
    pattern = rf"[\p{{Han}}\p{{Hiragana}}]{mark}*|{runs}|{joined}"
    return "regexp_extract_all(lower({0}), '" + pattern.replace("{", "{{").replace("}", "}}") + "')"


WORDS = _word_sql()
# What the stand-in for a model calls a word.
PLAIN_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"

def words_by_character(table: str, key: str, text: str, name: str) -> str:
    """{name}_words (key, term): the words of a text by the classes of its characters, one by one.

    h: a word of its own, k and t: runs, l, d, e: letters, digits and what joins them, m: between two
    letters or two digits.
    """
    return f"""{name}_chars AS (
      SELECT {key}, unnest(string_split(lower({text}), '')) AS c, generate_subscripts(string_split(lower({text}), ''), 1) AS i FROM {table}),
    {name}_classed AS (
      SELECT *, CASE WHEN unicode(c) BETWEEN 19968 AND 40959 OR unicode(c) BETWEEN 12353 AND 12438 THEN 'h'
          WHEN unicode(c) BETWEEN 12448 AND 12543 THEN 'k' WHEN unicode(c) BETWEEN 3585 AND 3662 THEN 't'
          WHEN c BETWEEN '0' AND '9' THEN 'd' WHEN c = '_' THEN 'e' WHEN lower(c) <> upper(c) OR c = 'ß' THEN 'l'
          WHEN c IN ('.', chr(39), '’') THEN 'b' WHEN c = ':' THEN 'bl' WHEN c IN (',', ';') THEN 'bd' ELSE 'o' END AS k
      FROM {name}_chars),
    {name}_near AS (
      SELECT *, lag(k) OVER (PARTITION BY {key} ORDER BY i) AS p, lead(k) OVER (PARTITION BY {key} ORDER BY i) AS n FROM {name}_classed),
    {name}_joined AS (
      SELECT {key}, i, c, CASE WHEN k IN ('b', 'bl') AND p = 'l' AND n = 'l' THEN 'm' WHEN k IN ('b', 'bd') AND p = 'd' AND n = 'd' THEN 'm'
          WHEN k IN ('b', 'bl', 'bd') THEN 'o' ELSE k END AS k FROM {name}_near),
    {name}_starts AS (
      SELECT *, CASE WHEN k IN ('l', 'd', 'e', 'm') AND lag(k) OVER (PARTITION BY {key} ORDER BY i) IN ('l', 'd', 'e', 'm') THEN 0
          WHEN k IN ('k', 't') AND lag(k) OVER (PARTITION BY {key} ORDER BY i) = k THEN 0 ELSE 1 END AS begins FROM {name}_joined),
    {name}_numbered AS (SELECT *, sum(begins) OVER (PARTITION BY {key} ORDER BY i) AS no FROM {name}_starts),
    {name}_whole AS (
      SELECT {key}, no, string_agg(c, '' ORDER BY i) AS term FROM {name}_numbered WHERE k <> 'o'
      GROUP BY {key}, no HAVING count(*) FILTER (k IN ('l', 'd', 'k', 't', 'h')) > 0),
    {name}_words AS (
      SELECT {key}, unnest(list_transform(range(0, (length(term) - 1) // 255 + 1), lambda j: substr(term, j * 255 + 1, 255))) AS term
      FROM {name}_whole)"""


INDEX_CTE = f"""{DOCS_CTE},
  field_words AS (
    SELECT song_id, 'song_name' AS field, {WORDS.format('song_name')} AS w FROM docs
    UNION ALL SELECT song_id, 'name_artists', {WORDS.format('name_artists')} FROM docs
    UNION ALL SELECT song_id, 'lyrics', {WORDS.format('lyrics')} FROM docs),
  sized AS (SELECT *, len(w) AS dl FROM field_words WHERE len(w) > 0),
  fields AS (SELECT field, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS n_words,
                    CAST(sum(dl) AS DOUBLE) / count(*) AS avg_dl FROM sized GROUP BY field),
  counts AS (SELECT song_id, field, dl, term, count(*) AS tf
             FROM (SELECT song_id, field, dl, unnest(w) AS term FROM sized) GROUP BY ALL),
  terms AS (SELECT field, term, count(*) AS df FROM counts GROUP BY ALL),
  postings AS (SELECT c.song_id, c.field, c.term, c.tf, c.dl,
                      2.2e0 * c.tf / (c.tf + 1.2e0 * (0.25e0 + 0.75e0 * c.dl / f.avg_dl)) AS impact
               FROM counts c JOIN fields f USING (field))"""


def catalog_build(spark, sf_dir):
    rows = inputs.catalog(spark, sf_dir)
    return rows.select(*SHOWN, "s_artists", F.size("embedding").alias("dims")).withColumn(
        "dims", F.when(F.col("dims") >= 0, F.col("dims"))
    )


def join_ci(spark, sf_dir):
    songs = view(spark, sf_dir, "songs").select("song_id", "song_name")
    rows = ct.join_ignoring_case(songs, view(spark, sf_dir, "lyrics"), "song_id")
    return rows.select("song_id", "song_name", F.char_length("lyrics").cast("long").alias("n_chars"))


def join_collated(spark, sf_dir):
    """Keys that differ in case, accents and blanks at their end."""
    songs = view(spark, sf_dir, "accented_songs")
    rows = ct.join_ignoring_case(songs, view(spark, sf_dir, "plain_lyrics"), "song_id")
    return rows.select("song_id", "song_name", F.char_length("lyrics").cast("long").alias("n_chars"))


def join_artist_key(spark, sf_dir):
    rows = ct.join_artist(view(spark, sf_dir, "songs"), view(spark, sf_dir, "artists"))
    return rows.select("song_id", "artist_key", "artist_id", "name_artists", "main_genre")


def index_docs(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select(*SHOWN)


def index_rejects(spark, sf_dir):
    return ct.rejected_documents(inputs.tables(spark, sf_dir), inputs.DIMS)


def index_summary(spark, sf_dir):
    return ct.index_summary(inputs.tables(spark, sf_dir), inputs.DIMS)


def tokens(spark, sf_dir):
    lyrics = view(spark, sf_dir, "lyrics").select(F.explode(words(F.col("lyrics"))).alias("term"))
    return lyrics.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def tokens_scripts(spark, sf_dir):
    """Words of lyrics that mix Latin letters with Japanese or Thai."""
    lyrics = view(spark, sf_dir, "lyrics_scripts").select(F.explode(words(F.col("lyrics"))).alias("term"))
    return lyrics.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def index_postings(spark, sf_dir):
    rows = ix.build_index(inputs.stored_documents(spark, sf_dir)).postings
    dl, impact = F.col("dl").cast("long").alias("dl"), F.round("impact", 6).alias("impact")
    return rows.select("song_id", "field", "term", "tf", dl, impact)


def index_stats(spark, sf_dir):
    index = ix.build_index(inputs.stored_documents(spark, sf_dir))
    met = index.terms.join(F.broadcast(index.fields), "field")
    return met.select("field", "term", "df", F.round(ix.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def index_fields(spark, sf_dir):
    rows = ix.field_stats(inputs.stored_documents(spark, sf_dir))
    return rows.select("field", "n_docs", "n_words", F.round("avg_dl", 6).alias("avg_dl"))


def filter_energy(spark, sf_dir):
    rows = fl.range_filter(inputs.documents(spark, sf_dir), "energy", 0.0, 0.5)
    return rows.select("song_id", "energy")


def filter_popularity(spark, sf_dir):
    rows = fl.range_filter(inputs.documents(spark, sf_dir), "popularity", 10)
    return rows.select("song_id", "popularity")


def filter_energy_files(spark, sf_dir):
    """The same from documents laid out by value, of which only the files in range are read."""
    rows = clustered.read(spark, inputs.documents_by_value(spark, sf_dir), {"energy": [(0.0, 0.5)]})
    return rows.select("song_id", "energy")


def filter_popularity_files(spark, sf_dir):
    rows = clustered.read(spark, inputs.documents_by_value(spark, sf_dir), {"popularity": [(10, None)]})
    return rows.select("song_id", "popularity")


def filter_both_files(spark, sf_dir):
    """Both values at once, of one the two ends of its range."""
    wanted = {"energy": [(None, 0.2), (0.7, None)], "popularity": [(5, 60)]}
    rows = clustered.read(spark, inputs.documents_by_value(spark, sf_dir), wanted)
    return rows.select("song_id", "energy", "popularity")


def filter_artist(spark, sf_dir):
    rows = fl.match_filter(inputs.documents(spark, sf_dir), "name_artists", "Nobody or SUPPLIER")
    return rows.select("song_id", "name_artists")


def artist_parse(spark, sf_dir):
    both = view(spark, sf_dir, "songs").select("song_id", "artists").unionByName(
        view(spark, sf_dir, "match_songs").select("song_id", "artists")
    )
    artist = first_artist(F.col("artists"))
    return both.select(
        "song_id",
        first_quoted(F.col("artists")).alias("artist_key"),
        artist.alias("artist"),
        clean_artist(artist).alias("artist_clean"),
    )


def artist_parse_simple(spark, sf_dir):
    songs = view(spark, sf_dir, "songs")
    return songs.select("song_id", first_artist_simple(F.col("artists")).alias("artist"))


def table_counts(spark, sf_dir):
    return audit.table_counts({name: base_table(spark, sf_dir, name) for name in BASE_TABLES})


def catalog_like(spark, sf_dir):
    parts = [view(spark, sf_dir, n) for n in ("songs", "tracks", "albums", "song_links")]
    return audit.linked_songs_like(*parts, "RED")


def catalog_like_indexed(spark, sf_dir):
    """The same with the songs found through the index of names."""
    songs = name_index.songs_containing(spark, inputs.named_songs(spark, sf_dir, "case"), "RED")
    return audit.linked_songs_like(songs, *[view(spark, sf_dir, n) for n in ("tracks", "albums", "song_links")], "RED")


def catalog_preview(spark, sf_dir):
    return _previewed(spark, sf_dir, view(spark, sf_dir, "songs"))


def catalog_preview_indexed(spark, sf_dir):
    """The same with the songs found through the index of names."""
    return _previewed(spark, sf_dir, name_index.songs_containing(spark, inputs.named_songs(spark, sf_dir, "collation"), "Ring"))


def _previewed(spark, sf_dir, songs):
    rows = audit.embedding_preview(songs, view(spark, sf_dir, "song_embeddings"), "Ring")
    entries = [F.round(F.get("first_values", F.lit(i)).cast("double"), 6).alias(f"e{i}") for i in range(3)]
    return rows.select("song_id", "song_name", "artists", *entries)


QUERIES = {
    f.__name__: f
    for f in (
        catalog_build, join_ci, join_collated, join_artist_key, index_docs, index_rejects, index_summary, tokens, tokens_scripts,
        index_postings, index_stats, index_fields, filter_energy, filter_popularity, filter_artist,
        filter_energy_files, filter_popularity_files, filter_both_files, catalog_like_indexed, catalog_preview_indexed,
        artist_parse, artist_parse_simple, table_counts, catalog_like, catalog_preview,
    )
}

_shown = ", ".join(SHOWN)
_from_catalog = lambda body: with_views(CATALOG_VIEWS, f"WITH {CATALOG_CTE} {body}")
_from_docs = lambda body: with_views(CATALOG_VIEWS, f"WITH {DOCS_CTE} {body}")
_from_index = lambda body: with_views(CATALOG_VIEWS, f"WITH {INDEX_CTE} {body}")

FIRST_ARTIST = """CASE
    WHEN coalesce(artists, '') = '' THEN NULL
    WHEN contains(artists, '{') AND contains(artists, ':') AND contains(artists, '}') THEN
      CASE WHEN json_valid(replace(artists, '''', '"'))
           THEN json_extract_string(replace(artists, '''', '"'), '$.*')[1]
           ELSE nullif(trim(rtrim(trim(split_part(artists, ':', -1)), '}'), ' "'''), '') END
    WHEN json_valid(artists) THEN json_extract_string(artists, '$[0]')
    ELSE trim(split_part(artists, ',', 1)) END"""

ORACLES = {
    "catalog_build": _from_catalog(
        f"SELECT {_shown}, s_artists, CAST(len(embedding) AS INTEGER) AS dims FROM catalog"
    ),
    "join_ci": with_views(
        "songs lyrics",
        "SELECT s.song_id, s.song_name, CAST(length(l.lyrics) AS BIGINT) AS n_chars "
        "FROM songs s LEFT JOIN lyrics l ON lower(s.song_id) = lower(l.song_id)",
    ),
    "join_collated": with_views(
        "accented_songs plain_lyrics",
        """WITH a AS (SELECT *, strip_accents(replace(lower(rtrim(song_id, ' ')), 'ß', 's')) AS k FROM accented_songs),
        b AS (SELECT *, strip_accents(replace(lower(rtrim(song_id, ' ')), 'ß', 's')) AS k FROM plain_lyrics)
        SELECT a.song_id, a.song_name, CAST(length(b.lyrics) AS BIGINT) AS n_chars FROM a LEFT JOIN b ON a.k = b.k""",
    ),
    "join_artist_key": with_views(
        "songs artists",
        f"SELECT s.song_id, {TOKEN} AS artist_key, a.artist_id, a.name AS name_artists, a.main_genre "
        f"FROM songs s LEFT JOIN artists a ON a.artist_id = {TOKEN}",
    ),
    "index_docs": _from_docs(f"SELECT {_shown} FROM docs"),
    "index_rejects": _from_docs("SELECT song_id, reason, count(*) AS n_rows FROM checked WHERE reason IS NOT NULL GROUP BY song_id, reason"),
    "index_summary": _from_docs(
        "SELECT CASE WHEN reason IS NULL THEN 'indexed' ELSE 'rejected' END AS status, "
        "coalesce(reason, '') AS reason, count(*) AS n_rows FROM checked GROUP BY 1, 2"
    ),
    "tokens": with_views(
        "lyrics",
        f"SELECT term, count(*) AS n FROM (SELECT unnest({WORDS.format('lyrics')}) AS term FROM lyrics) GROUP BY term",
    ),
    "tokens_scripts": with_views(
        "lyrics_scripts",
        f"WITH {words_by_character('lyrics_scripts', 'song_id', 'lyrics', 'w')} SELECT term, count(*) AS n FROM w_words GROUP BY term",
    ),
    "index_postings": _from_index("SELECT song_id, field, term, tf, dl, round(impact, 6) AS impact FROM postings"),
    "index_stats": _from_index(
        "SELECT field, term, df, round(ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0)), 6) AS idf "
        "FROM terms JOIN fields USING (field)"
    ),
    "index_fields": _from_index("SELECT field, n_docs, n_words, round(avg_dl, 6) AS avg_dl FROM fields"),
    "filter_energy": _from_docs("SELECT song_id, energy FROM docs WHERE energy BETWEEN 0 AND 0.5e0"),
    "filter_popularity": _from_docs("SELECT song_id, popularity FROM docs WHERE popularity >= 10"),
    "filter_artist": _from_docs(
        f"SELECT song_id, name_artists FROM docs WHERE list_has_any({WORDS.format('name_artists')}, "
        "['nobody', 'or', 'supplier'])"
    ),
    "artist_parse": with_views(
        "songs match_songs",
        f"""WITH b AS (SELECT song_id, artists FROM songs UNION ALL SELECT song_id, artists FROM match_songs),
        p AS (SELECT song_id, {TOKEN.replace('s.artists', 'artists')} AS artist_key, {FIRST_ARTIST} AS artist FROM b)
        SELECT song_id, artist_key, artist, trim(split_part(artist, '(', 1)) AS artist_clean FROM p""",
    ),
    "artist_parse_simple": with_views(
        "songs",
        "SELECT song_id, CASE WHEN artists <> '' THEN trim(split_part(trim(split_part(artists, ',', 1)), '(', 1)) END "
        "AS artist FROM songs",
    ),
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in BASE_TABLES
    ),
    "catalog_like": with_views(
        "songs tracks albums song_links",
        """WITH linked AS (
          SELECT song_id, song_name, artists, spotify_url, youtube_music_url FROM songs JOIN song_links USING (song_id)
          WHERE spotify_url IS NOT NULL AND youtube_music_url IS NOT NULL AND contains(lower(song_name), 'red'))
        SELECT song_id, song_name, artists, name AS album_name, spotify_url, youtube_music_url
        FROM linked LEFT JOIN tracks USING (song_id) LEFT JOIN albums USING (album_id)""",
    ),
    "catalog_preview": with_views(
        "songs song_embeddings",
        "SELECT song_id, song_name, artists, "
        + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS e{i}" for i in range(3))
        + " FROM songs LEFT JOIN song_embeddings USING (song_id) WHERE song_name ILIKE '%Ring%'",
    ),
}
ORACLES |= {
    "filter_energy_files": ORACLES["filter_energy"],
    "filter_popularity_files": ORACLES["filter_popularity"],
    "filter_both_files": _from_docs(
        "SELECT song_id, energy, popularity FROM docs WHERE (energy <= 0.2e0 OR energy >= 0.7e0) AND popularity BETWEEN 5 AND 60"
    ),
    "catalog_like_indexed": ORACLES["catalog_like"],
    "catalog_preview_indexed": ORACLES["catalog_preview"],
}
