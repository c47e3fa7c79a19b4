"""The catalogue tables, expressed over the given parquet tables.

Every view is one SQL text that both Spark and the SQL oracle accept, and reads whole
tables. Missing partners are natural: only some documents have a vector or a label, only some
have a page, and half of the language groups name their artist in a form without an id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS = {
    "songs": """
        SELECT CAST(d.doc_id AS STRING) AS song_id,
               p.p_name AS song_name,
               CASE d.lang
                 WHEN 'en' THEN '{''' || d.source || ''': ''Artist ' || d.source || '''}'
                 WHEN 'fr' THEN '{''' || d.source || ''': "D''Artagnan ' || d.source || '"}'
                 WHEN 'de' THEN '["Artist ' || d.source || '", "Guest"]'
                 ELSE 'Artist ' || d.source || ' (feat. Guest), Other' END AS artists,
               p.p_size AS popularity,
               lower(p.p_type) AS song_type,
               CASE WHEN p.p_type = 'PROMO' THEN p.p_brand || ' chart' END AS billboard
        FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id""",
    "lyrics": "SELECT CAST(doc_id AS STRING) AS song_id, text AS lyrics FROM documents",
    "lyrics_scripts": """
        SELECT CAST(doc_id AS STRING) AS song_id,
               CASE lang WHEN 'de' THEN translate(lower(text), 'etaonisr', '東京タワーの夜カ')
                         WHEN 'fr' THEN translate(lower(text), 'aeiou', 'กาไทย') ELSE text END AS lyrics
        FROM documents""",
    "accented_songs": """
        SELECT CAST(doc_id AS STRING) || ' Élan ' || left(text, 10) AS song_id, lang AS song_name FROM documents""",
    "plain_lyrics": """
        SELECT translate(CAST(doc_id AS STRING) || ' élan ' || left(text, 10), 'éèáíóúñüöäEAIOabcdefgh',
                         'eeaiounuoaeaioABCDEFGH') || '  ' AS song_id,
               text AS lyrics FROM documents WHERE doc_id % 3 > 0""",
    "prompts_scripts": """
        SELECT item_id AS query_id,
               CASE WHEN item_id % 2 = 0 THEN translate(lower(text), 'etaonisr', '東京タワーの夜カ')
                    ELSE translate(lower(text), 'aeiou', 'กาไทย') END AS prompt
        FROM benchmark""",
    "song_embeddings": "SELECT CAST(vec_id AS STRING) AS song_id, embedding FROM embeddings",
    "artists": """
        SELECT 'src' || CAST(s.s_suppkey AS STRING) AS artist_id,
               'Artist ' || s.s_name AS name, 'band' AS artist_type,
               lower(n.n_name) AS main_genre, lower(r.r_name) AS genres,
               'https://img.example.com/' || s.s_name AS image_url
        FROM supplier s
        LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
        LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "acoustic_features": """
        SELECT CAST(l.doc_id AS STRING) AS song_id, l.quality * p.p_size / 50e0 AS energy
        FROM labels l LEFT JOIN part p ON p.p_partkey = l.doc_id""",
    "tracks": """
        SELECT CAST(o_custkey AS STRING) AS song_id, CAST(o_orderkey AS STRING) AS album_id,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS release_date FROM orders""",
    "albums": "SELECT CAST(p_partkey AS STRING) AS album_id, p_name || ' ' || p_brand AS name FROM part",
    "song_links": """
        SELECT CAST(page_id AS STRING) AS song_id,
               CASE WHEN url NOT LIKE '%utm_source%' THEN url END AS spotify_url,
               CASE WHEN html LIKE '%lang="en"%' THEN 'https://music.example.com/watch?v=' || CAST(page_id AS STRING)
                    WHEN html LIKE '%lang="de"%' THEN '' END AS youtube_music_url
        FROM pages""",
    "user_playlists": """
        SELECT event_id AS id, CAST(user_id AS STRING) AS user_id, event_type AS playlist_name,
               CASE WHEN value >= 1 THEN props ELSE '' END AS song_data FROM events""",
    "broken_playlists": """
        SELECT event_id AS id, CAST(user_id AS STRING) AS user_id, event_type AS playlist_name,
               CASE WHEN event_type = 'error' OR event_id % 7 = 3 THEN 'no json ' || event_type
                    WHEN value >= 1 THEN props ELSE '' END AS song_data FROM events""",
    "album_songs": """
        SELECT CAST(o.o_custkey AS STRING) AS song_id, p.p_name AS song_name,
               CASE WHEN o.o_custkey % 3 = 0 THEN 'Supplier#0000' END AS artists,
               CASE WHEN o.o_orderstatus <> 'P' THEN a.p_brand END AS album_name
        FROM orders o
        LEFT JOIN part p ON p.p_partkey = o.o_custkey
        LEFT JOIN part a ON a.p_partkey = o.o_orderkey % 50""",
    "album_candidates": """
        SELECT CAST(o.o_custkey AS STRING) AS song_id,
               CASE WHEN o.o_orderstatus <> 'P' THEN a.p_brand END AS searched_album,
               CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 2 END AS strategy_no,
               l.l_linenumber AS pos, p.p_name AS title, s.s_name AS artist_1, p.p_type AS artist_2,
               CASE WHEN l.l_tax > 0 THEN p.p_brand ELSE '' END AS album,
               CASE WHEN l.l_returnflag = 'R' THEN 'video' ELSE 'song' END AS result_type,
               CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_partkey AS STRING) AS url
        FROM lineitem l
        JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN part p ON p.p_partkey = CASE WHEN l.l_linenumber = 1 THEN o.o_custkey ELSE l.l_partkey END
        JOIN supplier s ON s.s_suppkey = l.l_suppkey
        LEFT JOIN part a ON a.p_partkey = o.o_orderkey % 50
        WHERE l.l_discount > 0.02""",
    "timed_links": """
        SELECT CAST(page_id AS STRING) AS song_id,
               CASE WHEN url NOT LIKE '%utm_source%' THEN url END AS spotify_url,
               CASE WHEN page_id % 5 = 0 THEN 'https://patched.example.com/' || CAST(page_id AS STRING) END AS youtube_music_url,
               CAST('2020-01-01 00:00:00' AS TIMESTAMP) AS created_at, CAST('2020-01-02 00:00:00' AS TIMESTAMP) AS updated_at
        FROM pages""",
    "queries": """
        SELECT b.item_id AS query_id, p.p_name || ' ' || b.text AS prompt, e.embedding AS vec,
               CASE p.p_type WHEN 'PROMO' THEN 0.25e0 WHEN 'SMALL' THEN 0.5e0 END AS energy_min,
               CASE p.p_type WHEN 'PROMO' THEN 0.9e0 WHEN 'ECONOMY' THEN 0e0 END AS energy_max,
               CASE p.p_type WHEN 'LARGE' THEN 'the SUPPLIER' WHEN 'SMALL' THEN '' END AS artist,
               CASE p.p_type WHEN 'MEDIUM' THEN p.p_size END AS popularity_min,
               CASE p.p_type WHEN 'MEDIUM' THEN p.p_size + 1 WHEN 'LARGE' THEN p.p_size END AS popularity_max
        FROM benchmark b
        LEFT JOIN part p ON p.p_partkey = b.item_id
        LEFT JOIN embeddings e ON e.vec_id = b.item_id""",
    "candidates": """
        SELECT CAST(l.l_orderkey AS STRING) AS song_id,
               CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 2 END AS strategy_no,
               l.l_linenumber AS pos, p.p_name AS title, s.s_name AS artist_1, p.p_type AS artist_2,
               CASE WHEN l.l_tax > 0 THEN p.p_brand ELSE '' END AS album,
               CASE WHEN l.l_returnflag = 'R' THEN 'video' ELSE 'song' END AS result_type,
               CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) AS url
        FROM lineitem l
        JOIN part p ON p.p_partkey = l.l_partkey
        JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "match_songs": """
        SELECT CAST(o.o_orderkey AS STRING) AS song_id,
               CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F' THEN 'None'
                    WHEN o.o_orderstatus = 'P' THEN p.p_name || ' Live ' ELSE p.p_name END AS song_name,
               CASE o.o_orderpriority
                 WHEN '2-HIGH' THEN '{''a1'': ''Supplier'', ''a2'': ''Guest''}'
                 WHEN '3-MEDIUM' THEN '["Supplier#0000", "Guest"]'
                 WHEN '4-NOT SPECIFIED' THEN 'standard (feat. Guest), Other'
                 WHEN '5-LOW' THEN NULL ELSE '' END AS artists,
               CASE WHEN o.o_orderstatus = 'O' THEN p.p_brand END AS album_name
        FROM orders o LEFT JOIN part p ON p.p_partkey = o.o_custkey""",
    "playlist_commands": """
        SELECT o_orderkey AS seq,
               CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'replace' END AS op,
               CAST(o_custkey AS STRING) AS user_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'click' WHEN '2-HIGH' THEN 'view'
                 WHEN '3-MEDIUM' THEN 'purchase' ELSE 'party' END AS playlist_name,
               CASE WHEN o_orderstatus = 'O' THEN '{"title": "' || o_orderpriority || '"}' END AS song_1,
               CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 1000 THEN '{"title": "second"}' END AS song_2
        FROM orders""",
    "link_patch": """
        SELECT CAST(p.page_id AS STRING) AS song_id,
               CASE WHEN d.lang = 'en' THEN 'spotify_url' ELSE 'youtube_music_url' END AS link_column,
               'https://patched.example.com/' || CAST(p.page_id AS STRING) AS link_value
        FROM pages p JOIN documents d ON d.doc_id = p.page_id
        WHERE p.url LIKE '%utm_source%' OR p.html LIKE '%lang="es"%'""",
}


_opened: dict[str, DataFrame] = {}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; the footer that holds its schema is read once per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _opened or _opened[path].sparkSession is not spark:
        _opened[path] = spark.read.parquet(path)
    return _opened[path]


def _tables_in(query: str) -> list[str]:
    named = re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", query)
    return [table for table in BASE_TABLES if table in named]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One catalogue table over the parquet files of sf_dir."""
    for table in _tables_in(VIEWS[name]):
        base_table(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(VIEWS[name])


def with_views(names: str, query: str) -> str:
    """Oracle text: the named views as common table expressions, then the query."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in names.split()]
    joiner = ", " if query.lstrip().upper().startswith("WITH ") else " "
    body = query.lstrip()[5:] if joiner == ", " else query
    return "WITH " + ", ".join(parts) + joiner + body
