"""Registered queries of the embedding job and the playlists, with their oracle texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.vectors import parse_vector
from cadenza.operators import embedding as em, mutations as mu, playlists as pl
from cadenza.plans import inputs
from cadenza.plans.catalog_plans import PLAIN_WORDS
from cadenza.session import new_path
from cadenza.sources import tables as tb
from cadenza.sources.catalog_views import base_table, view, with_views
from cadenza.streaming import apply as st


def _texts(spark, sf_dir):
    return em.song_texts(view(spark, sf_dir, "songs"), view(spark, sf_dir, "lyrics"))


def embed_text(spark, sf_dir):
    return _texts(spark, sf_dir)


def embed_clip(spark, sf_dir):
    return em.clip_texts(_texts(spark, sf_dir))


def _signs(vector):
    """Whole numbers that describe a vector: its width, and how many entries are above and below 0."""
    above, below = F.filter(vector, lambda x: x > 0), F.filter(vector, lambda x: x < 0)
    return [F.size(c).cast("long").alias(n) for c, n in ((F.col(vector), "dims"), (above, "above"), (below, "below"))]


def embed_batch(spark, sf_dir):
    rows = em.embed_texts(em.clip_texts(_texts(spark, sf_dir)), em.hashed_words(inputs.DIMS))
    return rows.select("song_id", *_signs("embedding"), "error")


def embed_prompts(spark, sf_dir):
    rows = em.embed_prompts(view(spark, sf_dir, "queries"), em.hashed_words(inputs.DIMS))
    return rows.select("query_id", *_signs("vec"))


def _new_vectors(spark, sf_dir):
    labels, part = base_table(spark, sf_dir, "labels"), base_table(spark, sf_dir, "part")
    vectors = base_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = labels.join(part, labels.doc_id == part.p_partkey).join(vectors, F.col("vec_id") == F.col("p_size"))
    return rows.select(
        F.col("doc_id").cast("string").alias("song_id"), F.when(F.col("quality") == 1, F.col("embedding")).alias("embedding")
    )


def _weighted(vector):
    """A sum over all entries, each times its place from 1, which tells vectors apart."""
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 5)


def _vector_shape(rows):
    dims = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return rows.select("song_id", dims.alias("dims"), _weighted("embedding").alias("weighted"))


def embed_upsert(spark, sf_dir):
    return _vector_shape(mu.upsert_embeddings(view(spark, sf_dir, "song_embeddings"), _new_vectors(spark, sf_dir)))


def embed_upsert_keep(spark, sf_dir):
    old = view(spark, sf_dir, "song_embeddings")
    return _vector_shape(mu.upsert_embeddings(old, _new_vectors(spark, sf_dir), keep_existing=True))


def vectors_json(spark, sf_dir):
    """Vectors written as JSON and read again; some are empty text, some the word null."""
    rows = base_table(spark, sf_dir, "embeddings")
    kind = F.col("vec_id") % 10
    text = F.when(kind == 0, "").when(kind == 1, "null").otherwise(F.to_json("embedding"))
    read = rows.select(F.col("vec_id").cast("string").alias("song_id"), parse_vector(text).alias("embedding"))
    return _vector_shape(read)


def dump_restore(spark, sf_dir):
    """The link table, dumped to the shared folder and restored from there."""
    path = new_path(spark, "dump")
    tb.dump_table(view(spark, sf_dir, "song_links"), path)
    return tb.restore_table(spark, path)


def column_status(spark, sf_dir):
    return tb.column_status(view(spark, sf_dir, "songs"))


def playlists_by_user(spark, sf_dir):
    return pl.playlists_by_user(view(spark, sf_dir, "user_playlists"))


def playlist_pages(spark, sf_dir):
    rows = pl.playlist_pages(view(spark, sf_dir, "user_playlists"), page=10)
    return rows.select("user_id", "playlist_name", "page_no", F.array_join("songs", "|").alias("songs"), "n_bad")


def playlist_pages_bad(spark, sf_dir):
    """Pages of playlists in which some songs, and in some playlists all, are no JSON."""
    rows = pl.playlist_pages(view(spark, sf_dir, "broken_playlists"), page=10)
    return rows.select("user_id", "playlist_name", "page_no", F.array_join("songs", "|").alias("songs"), "n_bad")


NEW_SONGS = ['{"title": "one"}', '{"title": "two"}']


def playlist_apply(spark, sf_dir):
    return pl.replace_playlist(view(spark, sf_dir, "user_playlists"), "3", "click", NEW_SONGS)


def playlist_delete(spark, sf_dir):
    rows = pl.delete_playlist(view(spark, sf_dir, "user_playlists"), "3", "click")
    return rows.select("id", "user_id", "playlist_name", "song_data")


def _commands(spark, sf_dir):
    songs = F.filter(F.array("song_1", "song_2"), lambda s: s.isNotNull()).alias("songs")
    rows = view(spark, sf_dir, "playlist_commands")
    return rows.select("seq", "op", "user_id", "playlist_name", songs)


def playlist_commands(spark, sf_dir):
    return pl.apply_playlist_commands(view(spark, sf_dir, "user_playlists"), _commands(spark, sf_dir))


def playlist_stream(spark, sf_dir):
    """The same commands, arriving as files."""
    home = new_path(spark, "playlists")
    st.create_playlists(view(spark, sf_dir, "user_playlists"), f"{home}/table")
    _commands(spark, sf_dir).write.parquet(f"{home}/inbox")
    run = st.stream_playlist_commands(spark, f"{home}/inbox", f"{home}/table", f"{home}/progress")
    run.awaitTermination()
    return st.read_rows(spark, f"{home}/table")


QUERIES = {
    f.__name__: f
    for f in (
        embed_text, embed_clip, embed_batch, embed_prompts, embed_upsert, embed_upsert_keep, vectors_json,
        dump_restore, column_status, playlists_by_user,
        playlist_pages, playlist_pages_bad, playlist_apply, playlist_delete, playlist_commands, playlist_stream,
    )
}

TEXT_CTE = """texts AS (
    SELECT s.song_id, CASE WHEN coalesce(s.billboard, '') = '' THEN coalesce(l.lyrics, '')
           ELSE s.billboard || chr(10) || chr(10) || coalesce(l.lyrics, '') END AS text
    FROM songs s LEFT JOIN lyrics l ON lower(s.song_id) = lower(l.song_id))"""

_BLANK = "[ \\t\\n\\r\\f]"
_INK = "[^ \\t\\n\\r\\f]"

CLIP_CTE = f"""heads AS (SELECT *, regexp_extract(text, '^(?:{_BLANK}*{_INK}+){{0,400}}') AS head FROM texts),
  clipped AS (
    SELECT song_id, CASE WHEN regexp_matches(substr(text, length(head) + 1), '{_INK}') THEN head ELSE text END AS text
    FROM heads)"""


def _slots(table: str, key: str, text: str) -> str:
    """The hashed-words vector of every text, before scaling, one row per slot that is hit."""
    return f"""codes AS (
      SELECT {key}, CAST('0x' || substr(md5(word), 1, 16) AS UBIGINT) AS code
      FROM (SELECT {key}, unnest({PLAIN_WORDS.format(text)}) AS word FROM {table})),
    slots AS (SELECT {key}, code % {inputs.DIMS} AS slot, sum(CASE WHEN code >= 9223372036854775808 THEN 1 ELSE -1 END) AS v
              FROM codes GROUP BY ALL)"""


_SIGNS = f"{inputs.DIMS}::BIGINT AS dims, count(*) FILTER (v > 0) AS above, count(*) FILTER (v < 0) AS below"

_WEIGHTED = "round(list_sum(list_transform({0}, lambda x, i: CAST(x AS DOUBLE) * i)), 5)"

VECTORS_CTE = """fresh AS (
    SELECT CAST(l.doc_id AS VARCHAR) AS song_id, CASE WHEN l.quality = 1 THEN e.embedding END AS embedding
    FROM labels l JOIN part p ON p.p_partkey = l.doc_id JOIN embeddings e ON e.vec_id = p.p_size)"""

_vectors = lambda value: with_views(
    "song_embeddings",
    f"""WITH {VECTORS_CTE}, merged AS (
      SELECT coalesce(n.song_id, o.song_id) AS song_id, {value} AS v
      FROM song_embeddings o FULL JOIN fresh n ON n.song_id = o.song_id)
    SELECT song_id, CAST(len(v) AS INTEGER) AS dims, {_WEIGHTED.format('v')} AS weighted FROM merged""",
)

SONGS_CTE = """filled AS (
    SELECT user_id, playlist_name, song_data,
           row_number() OVER (PARTITION BY user_id, playlist_name ORDER BY id) - 1 AS pos
    FROM user_playlists WHERE song_data <> ''),
  listed AS (
    SELECT user_id, playlist_name, pos, song_data AS song, FALSE AS bad FROM filled
    UNION ALL SELECT user_id, playlist_name, NULL, NULL, FALSE FROM user_playlists
    GROUP BY user_id, playlist_name HAVING count(*) FILTER (song_data <> '') = 0)"""

COMMANDS_CTE = """last AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, playlist_name ORDER BY seq DESC) AS r
                   FROM playlist_commands) WHERE r = 1),
  kept AS (SELECT id, user_id, playlist_name, song_data FROM user_playlists p
           WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.user_id = p.user_id AND l.playlist_name = p.playlist_name)),
  added AS (
    SELECT seq, 0 AS place, user_id, playlist_name, song_1 AS song_data FROM last WHERE op = 'replace' AND song_1 IS NOT NULL
    UNION ALL SELECT seq, 1, user_id, playlist_name, song_2 FROM last WHERE op = 'replace' AND song_2 IS NOT NULL)"""

ORACLES = {
    "embed_text": with_views("songs lyrics", f"WITH {TEXT_CTE} SELECT song_id, text FROM texts"),
    "embed_clip": with_views("songs lyrics", f"WITH {TEXT_CTE}, {CLIP_CTE} SELECT song_id, text FROM clipped"),
    "embed_batch": with_views(
        "songs lyrics",
        f"WITH {TEXT_CTE}, {CLIP_CTE}, {_slots('clipped', 'song_id', 'text')} "
        f"SELECT song_id, {_SIGNS}, CAST(NULL AS VARCHAR) AS error "
        "FROM clipped LEFT JOIN slots USING (song_id) GROUP BY song_id",
    ),
    "embed_prompts": with_views(
        "queries",
        f"WITH {_slots('queries', 'query_id', 'prompt')} "
        f"SELECT query_id, {_SIGNS} FROM queries LEFT JOIN slots USING (query_id) GROUP BY query_id",
    ),
    "embed_upsert": _vectors("CASE WHEN n.song_id IS NOT NULL THEN n.embedding ELSE o.embedding END"),
    "embed_upsert_keep": _vectors("coalesce(n.embedding, o.embedding)"),
    "playlists_by_user": with_views("user_playlists", f"WITH {SONGS_CTE} SELECT * FROM listed"),
    "playlist_pages": with_views(
        "user_playlists",
        f"""WITH {SONGS_CTE} SELECT user_id, playlist_name, CAST(coalesce(pos // 10, 0) AS BIGINT) AS page_no,
        coalesce(string_agg(song, '|' ORDER BY pos), '') AS songs, 0::BIGINT AS n_bad FROM listed GROUP BY ALL""",
    ),
    "playlist_pages_bad": with_views(
        "broken_playlists",
        """WITH filled AS (
          SELECT user_id, playlist_name, song_data, json_valid(song_data) AS good,
                 row_number() OVER (PARTITION BY user_id, playlist_name ORDER BY id) - 1 AS pos
          FROM broken_playlists WHERE song_data <> ''),
        listed AS (
          SELECT user_id, playlist_name, pos, CASE WHEN good THEN song_data END AS song, NOT good AS bad FROM filled
          UNION ALL SELECT user_id, playlist_name, NULL, NULL, FALSE FROM broken_playlists
          GROUP BY user_id, playlist_name HAVING count(*) FILTER (song_data <> '') = 0)
        SELECT user_id, playlist_name, CAST(coalesce(pos // 10, 0) AS BIGINT) AS page_no,
               coalesce(string_agg(song, '|' ORDER BY pos), '') AS songs, count(*) FILTER (bad) AS n_bad
        FROM listed GROUP BY ALL""",
    ),
    "playlist_apply": with_views(
        "user_playlists",
        f"""SELECT id, user_id, playlist_name, song_data FROM user_playlists WHERE NOT (user_id = '3' AND playlist_name = 'click')
        UNION ALL SELECT (SELECT max(id) FROM user_playlists) + 1, '3', 'click', '{NEW_SONGS[0]}'
        UNION ALL SELECT (SELECT max(id) FROM user_playlists) + 2, '3', 'click', '{NEW_SONGS[1]}'""",
    ),
    "playlist_delete": with_views(
        "user_playlists",
        "SELECT id, user_id, playlist_name, song_data FROM user_playlists WHERE NOT (user_id = '3' AND playlist_name = 'click')",
    ),
    "playlist_commands": with_views(
        "user_playlists playlist_commands",
        f"""WITH {COMMANDS_CTE} SELECT id, user_id, playlist_name, song_data FROM kept
        UNION ALL SELECT (SELECT max(id) FROM user_playlists) + row_number() OVER (ORDER BY seq, place),
          user_id, playlist_name, song_data FROM added""",
    ),
}

ORACLES |= {
    "vectors_json": f"""SELECT CAST(vec_id AS VARCHAR) AS song_id,
      CASE WHEN vec_id % 10 > 1 THEN CAST(len(embedding) AS INTEGER) END AS dims,
      CASE WHEN vec_id % 10 > 1 THEN {_WEIGHTED.format('embedding')} END AS weighted FROM embeddings""",
    "dump_restore": with_views("song_links", "SELECT * FROM song_links"),
    "column_status": with_views(
        "songs",
        " UNION ALL ".join(
            f"SELECT '{name}' AS col_name, '{kind}' AS data_type, count({name}) AS n_given, count(*) AS n_rows FROM songs"
            for name, kind in (
                ("song_id", "string"), ("song_name", "string"), ("artists", "string"), ("popularity", "int"),
                ("song_type", "string"), ("billboard", "string"),
            )
        ),
    ),
}

ORACLES["playlist_stream"] = ORACLES["playlist_commands"]
