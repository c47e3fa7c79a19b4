"""Registered queries of link matching, link tables and the audit, with their oracle texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cadenza.functions.text import strip
from cadenza.operators import audit, link_run as lr, matching as mt, mutations as mu
from cadenza.plans.catalog_plans import FIRST_ARTIST
from cadenza.session import new_path
from cadenza.sources.catalog_views import base_table, view, with_views
from cadenza.streaming import apply as st


def _candidates(spark, sf_dir):
    rows = view(spark, sf_dir, "candidates")
    return rows.withColumn("artists", F.array("artist_1", "artist_2"))


def _cleaned(spark, sf_dir, simple=False):
    return mt.clean_input(view(spark, sf_dir, "match_songs"), simple)


def _matched(spark, sf_dir, rules, simple=False):
    return mt.match_links(_cleaned(spark, sf_dir, simple), _candidates(spark, sf_dir), rules)


def match_input(spark, sf_dir):
    return mt.match_input(*[view(spark, sf_dir, n) for n in ("songs", "tracks", "albums")])


def match_input_first(spark, sf_dir):
    """The first 500 rows of the job's input."""
    return mt.match_input(*[view(spark, sf_dir, n) for n in ("songs", "tracks", "albums")], limit=500)


def match_strategies(spark, sf_dir):
    rows = mt.search_texts(_cleaned(spark, sf_dir))
    return rows.select("song_id", "service", F.col("strategy_no").cast("long").alias("strategy_no"), "query")


def match_strategies_simple(spark, sf_dir):
    rows = mt.search_texts(_cleaned(spark, sf_dir, simple=True), skips_none=False)
    return rows.select("song_id", "service", F.col("strategy_no").cast("long").alias("strategy_no"), "query")


def _shown(rows):
    return rows.select(
        "song_id", "service", "url", F.col("tier").cast("long").alias("tier"),
        F.col("strategy_no").cast("long").alias("strategy_no"), F.col("pos").cast("long").alias("pos"), "title",
    )


def link_match_a(spark, sf_dir):
    return _shown(_matched(spark, sf_dir, mt.SERVICE_A))


def link_match_b(spark, sf_dir):
    return _shown(_matched(spark, sf_dir, mt.SERVICE_B))


def link_match_simple(spark, sf_dir):
    return _shown(_matched(spark, sf_dir, (mt.SERVICE_A_SIMPLE, mt.SERVICE_B_SIMPLE), simple=True))


def _both_services(spark, sf_dir):
    return _matched(spark, sf_dir, (mt.SERVICE_A, mt.SERVICE_B))


_runs: dict[tuple, lr.LinkRun] = {}


def _run(spark, sf_dir, albums=False, **widths):
    """A run for both services, matched and written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, albums, *widths.items())
    if key not in _runs:
        rows, offers = _album_inputs(spark, sf_dir) if albums else (_cleaned(spark, sf_dir), _candidates(spark, sf_dir))
        _runs[key] = lr.run_links(rows, offers, (mt.SERVICE_A, mt.SERVICE_B), lr.Widths(**widths))
    return _runs[key]


def link_failures(spark, sf_dir):
    return _run(spark, sf_dir).failures()


def link_summary(spark, sf_dir):
    return _run(spark, sf_dir).figures


# A table so narrow that some links do not fit.
NARROW = 6


def link_summary_narrow(spark, sf_dir):
    return _run(spark, sf_dir, url=NARROW + len(mt.WATCH)).figures


def link_save_narrow(spark, sf_dir):
    """What a run can save, put into the link table."""
    return mu.upsert_links(view(spark, sf_dir, "song_links"), _run(spark, sf_dir, url=NARROW + len(mt.WATCH)).updates())


def _album_inputs(spark, sf_dir):
    """Songs on several albums, and what was found for each with its own text."""
    cleaned = mt.clean_input(view(spark, sf_dir, "album_songs"))
    return cleaned, view(spark, sf_dir, "album_candidates").withColumn("artists", F.array("artist_1", "artist_2"))


def _by_album(spark, sf_dir):
    cleaned, offers = _album_inputs(spark, sf_dir)
    return cleaned, mt.match_links(cleaned, offers, (mt.SERVICE_A, mt.SERVICE_B))


def link_match_albums(spark, sf_dir):
    _, links = _by_album(spark, sf_dir)
    return links.select("song_id", "album_key", "service", "url", F.col("tier").cast("long").alias("tier"))


def link_summary_albums(spark, sf_dir):
    return _run(spark, sf_dir, albums=True).figures


def link_failures_albums(spark, sf_dir):
    return _run(spark, sf_dir, albums=True).failures()


def link_updates_albums(spark, sf_dir):
    return mt.link_updates(_by_album(spark, sf_dir)[1])


RUN_AT = datetime(2024, 5, 6)


def link_patch_times(spark, sf_dir):
    """A patch of rows with times; one that sets a link to what it was changes nothing."""
    rows = mu.patch_links(view(spark, sf_dir, "timed_links"), view(spark, sf_dir, "link_patch"), RUN_AT)
    day = F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on")
    return rows.select("song_id", "spotify_url", "youtube_music_url", day)


def link_save(spark, sf_dir):
    """The whole collection run: match for both services, then upsert into the link table."""
    updates = mt.link_updates(_both_services(spark, sf_dir))
    return mu.upsert_links(view(spark, sf_dir, "song_links"), updates)


def _updates(spark, sf_dir):
    labels = base_table(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string")
    return labels.select(
        key.alias("song_id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("https://a.example.com/"), key)).alias("spotify_url"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("https://b.example.com/"), key)).alias("youtube_music_url"),
    )


def link_upsert(spark, sf_dir):
    return mu.upsert_links(view(spark, sf_dir, "song_links"), _updates(spark, sf_dir))


def link_stream(spark, sf_dir):
    """The same updates, arriving as several files."""
    home = new_path(spark, "links")
    st.create_links(view(spark, sf_dir, "song_links"), f"{home}/table")
    arrivals = _updates(spark, sf_dir).withColumn("seq", F.col("song_id").cast("long"))
    arrivals.repartition(3, "song_id").write.parquet(f"{home}/inbox")
    run = st.stream_link_updates(spark, f"{home}/inbox", f"{home}/table", f"{home}/progress", files_per_batch=1)
    run.awaitTermination()
    return st.read_rows(spark, f"{home}/table")


def link_upsert_all(spark, sf_dir):
    return mu.upsert_links(view(spark, sf_dir, "song_links"), _updates(spark, sf_dir), keep_empty=True)


def link_patch(spark, sf_dir):
    return mu.patch_links(view(spark, sf_dir, "song_links"), view(spark, sf_dir, "link_patch"))


def link_coverage(spark, sf_dir):
    return audit.link_coverage(view(spark, sf_dir, "song_links"))


def coverage_after_patch(spark, sf_dir):
    return audit.link_coverage(link_patch(spark, sf_dir))


def text_strip(spark, sf_dir):
    parts = base_table(spark, sf_dir, "conversations")
    return parts.select("conv_id", "turn", strip(F.col("text")).alias("stripped"))


QUERIES = {
    f.__name__: f
    for f in (
        match_input, match_input_first, match_strategies, match_strategies_simple, link_match_a, link_match_b, link_match_simple, link_failures,
        link_summary, link_summary_narrow, link_save_narrow, link_match_albums, link_summary_albums, link_failures_albums, link_updates_albums,
        link_patch_times, link_save, link_upsert, link_stream, link_upsert_all, link_patch, link_coverage,
        coverage_after_patch, text_strip,
    )
}

CLEANED_CTE = f"""parsed AS (SELECT *, {FIRST_ARTIST} AS first_artist FROM match_songs),
  cleaned AS (
    SELECT song_id, song_name, trim(split_part(first_artist, '(', 1)) AS artist, trim(album_name) AS album,
           song_name IS NULL OR song_name IN ('', 'None') AS skipped FROM parsed),
  simple AS (
    SELECT song_id, song_name, CASE WHEN artists <> '' THEN trim(split_part(trim(split_part(artists, ',', 1)), '(', 1)) END AS artist,
           CAST(NULL AS VARCHAR) AS album, FALSE AS skipped FROM match_songs),
  offers AS (
    SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY strategy_no, pos, title, url) AS place,
           min(strategy_no) OVER (PARTITION BY song_id) AS first_strategy FROM candidates)"""


def _either(a: str, b: str) -> str:
    return f"(contains({a}, {b}) OR contains({b}, {a}))"


WATCH = "'https://music.youtube.com/watch?v='"


def _albums_cte() -> str:
    """Matches by song and album, one service after the other, from the definition."""
    body = f"""parsed AS (SELECT *, {FIRST_ARTIST} AS first_artist FROM album_songs),
      cleaned AS (
        SELECT song_id, song_name, trim(split_part(first_artist, '(', 1)) AS artist, trim(album_name) AS album,
               coalesce(trim(album_name), '') AS album_key,
               song_name IS NULL OR song_name IN ('', 'None') AS skipped FROM parsed),
      keyed_offers AS (SELECT *, coalesce(trim(searched_album), '') AS album_key FROM album_candidates),
      offers AS (
        SELECT *, row_number() OVER (PARTITION BY song_id, album_key ORDER BY strategy_no, pos, title, url) AS place,
               min(strategy_no) OVER (PARTITION BY song_id, album_key) AS first_strategy FROM keyed_offers),
      wanted AS (SELECT DISTINCT song_id, album_key, song_name, artist FROM cleaned WHERE NOT skipped)"""
    artist, offered, wanted = "trim(lower(s.artist))", "trim(lower(coalesce(c.album, '')))", "trim(lower(s.album_key))"
    song, title = "trim(lower(s.song_name))", "trim(lower(c.title))"
    artist_ok = f"(coalesce(s.artist, '') = '' OR {_either(artist, 'trim(lower(c.artist_1))')} OR {_either(artist, 'trim(lower(c.artist_2))')})"
    alike = f"({song} = {title} OR {_either(song, title)})"
    for name, service, gate, fits, url in (
        ("of_a", "A", "TRUE", _either(wanted, offered), "url"),
        ("of_b", "B", "c.result_type = 'song'", f"({offered} <> '' AND {_either(wanted, offered)})", f"{WATCH} || url"),
    ):
        near = f"({gate} AND {alike} AND {artist_ok})"
        album_ok = f"({wanted} = '' OR {fits})"
        body += f""",
      {name}_ranked AS (
        SELECT s.song_id, s.album_key, c.url, c.place,
               CASE WHEN {near} AND {song} = {title} AND {album_ok} THEN 1 WHEN {near} AND {album_ok} THEN 2
                    WHEN {near} THEN 3 ELSE 9 END AS tier
        FROM wanted s JOIN offers c ON c.song_id = s.song_id AND c.album_key = s.album_key
        WHERE c.strategy_no = c.first_strategy AND lower(s.song_name) <> 'none'),
      {name}_best AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id, album_key ORDER BY tier, place) AS r
                       FROM {name}_ranked) WHERE r = 1),
      {name} AS (
        SELECT w.song_id, w.album_key, '{service}' AS service, {url} AS url, CAST(tier AS BIGINT) AS tier
        FROM (SELECT DISTINCT song_id, album_key FROM wanted) w LEFT JOIN {name}_best b
          ON b.song_id = w.song_id AND b.album_key = w.album_key)"""
    return body + ", both_services AS (SELECT * FROM of_a UNION ALL SELECT * FROM of_b)"


def _match_sql(name: str, service: str, source: str, album: bool, open_album: bool, songs_only: bool) -> str:
    song, title = "trim(lower(s.song_name))", "trim(lower(c.title))"
    artist, offered = "trim(lower(s.artist))", "trim(lower(c.album))"
    wanted = "trim(lower(s.album))"
    artist_ok = f"(coalesce(s.artist, '') = '' OR {_either(artist, 'trim(lower(c.artist_1))')} OR {_either(artist, 'trim(lower(c.artist_2))')})"
    gate = "c.result_type = 'song'" if songs_only else "TRUE"
    album_test = _either(wanted, offered) if open_album else f"({offered} <> '' AND {_either(wanted, offered)})"
    album_ok = f"(coalesce(s.album, '') = '' OR {album_test})"
    alike = f"({song} = {title} OR {_either(song, title)})"
    near = f"({gate} AND {alike} AND {artist_ok})"
    tiers = (
        f"CASE WHEN {near} AND {song} = {title} AND {album_ok} THEN 1 WHEN {near} AND {album_ok} THEN 2 WHEN {near} THEN 3 ELSE 9 END"
        if album
        else f"CASE WHEN {near} THEN 1 ELSE 9 END"
    )
    usable = "lower(s.song_name) <> 'none'" if album else "s.song_name IS NOT NULL"
    return f"""{name}_pairs AS (
      SELECT s.song_id, c.url, c.strategy_no, c.pos, c.title, c.place, {tiers} AS tier
      FROM {source} s JOIN offers c ON c.song_id = s.song_id AND c.strategy_no = c.first_strategy
      WHERE NOT s.skipped AND {usable}),
    {name}_first AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY tier, place) AS r FROM {name}_pairs) WHERE r = 1),
    {name} AS (
      SELECT s.song_id, '{service}' AS service, {"'https://music.youtube.com/watch?v=' || f.url AS url" if service == "B" else "f.url"}, CAST(f.tier AS BIGINT) AS tier,
             CAST(f.strategy_no AS BIGINT) AS strategy_no, CAST(f.pos AS BIGINT) AS pos, f.title
      FROM {source} s LEFT JOIN {name}_first f ON f.song_id = s.song_id WHERE NOT s.skipped)"""


MATCH_A = _match_sql("match_a", "A", "cleaned", True, True, False)
MATCH_B = _match_sql("match_b", "B", "cleaned", True, False, True)
SIMPLE_A = _match_sql("simple_a", "A", "simple", False, True, False)
SIMPLE_B = _match_sql("simple_b", "B", "simple", False, False, True)
BOTH_CTE = f"{CLEANED_CTE}, {MATCH_A}, {MATCH_B}, both_services AS (SELECT * FROM match_a UNION ALL SELECT * FROM match_b)"

_match = lambda body: with_views("match_songs candidates", body)

UPDATES_CTE = """updates AS (
    SELECT CAST(doc_id AS VARCHAR) AS song_id,
           CASE WHEN quality = 1 THEN 'https://a.example.com/' || CAST(doc_id AS VARCHAR) END AS spotify_url,
           CASE WHEN toxic = 1 THEN 'https://b.example.com/' || CAST(doc_id AS VARCHAR) END AS youtube_music_url
    FROM labels)"""

_merged = """SELECT coalesce(u.song_id, o.song_id) AS song_id, coalesce(u.spotify_url, o.spotify_url) AS spotify_url,
    coalesce(u.youtube_music_url, o.youtube_music_url) AS youtube_music_url
  FROM song_links o FULL JOIN {0} u ON u.song_id = o.song_id"""

PATCH_CTE = """cells AS (
    SELECT song_id, max(CASE WHEN link_column = 'spotify_url' THEN link_value END) AS sp,
           max(CASE WHEN link_column = 'youtube_music_url' THEN link_value END) AS yt FROM link_patch GROUP BY song_id),
  patched AS (SELECT l.song_id, coalesce(c.sp, l.spotify_url) AS spotify_url,
                     coalesce(c.yt, l.youtube_music_url) AS youtube_music_url
              FROM song_links l LEFT JOIN cells c ON c.song_id = l.song_id)"""


def _coverage(table: str) -> str:
    def part(column, tag):
        return (
            f"count(*) FILTER ({column} IS NULL) AS {tag}_null, "
            f"round(count(*) FILTER ({column} IS NULL) / nullif(count(*), 0)::DOUBLE * 100, 2) AS {tag}_null_pct, "
            f"count({column}) AS {tag}_not_null, "
            f"round(count({column}) / nullif(count(*), 0)::DOUBLE * 100, 2) AS {tag}_not_null_pct"
        )

    return f"SELECT count(*) AS total, {part('spotify_url', 'sp')}, {part('youtube_music_url', 'yt')} FROM {table}"


FITS_CTE = f"""saves AS (
    SELECT song_id, max(coalesce(length(url), 0)) <= {NARROW} + length({WATCH}) AND length(song_id) <= 22 AS fits
    FROM both_services GROUP BY song_id)"""

ORACLES = {
    "match_input": with_views(
        "songs tracks albums",
        """SELECT s.song_id, s.song_name, s.artists, a.name AS album_name FROM songs s
        LEFT JOIN tracks t ON s.song_id = t.song_id LEFT JOIN albums a ON t.album_id = a.album_id""",
    ),
    "match_input_first": with_views(
        "songs tracks albums",
        """SELECT s.song_id, s.song_name, s.artists, a.name AS album_name FROM songs s
        LEFT JOIN tracks t ON s.song_id = t.song_id LEFT JOIN albums a ON t.album_id = a.album_id
        ORDER BY s.song_id, album_name NULLS FIRST LIMIT 500""",
    ),
    "match_strategies": with_views(
        "match_songs",
        f"""WITH {CLEANED_CTE.split('offers AS')[0].rstrip().rstrip(',')},
        usable AS (SELECT song_id, song_name, nullif(CASE WHEN lower(artist) <> 'none' THEN artist END, '') AS artist,
                   nullif(CASE WHEN lower(album) <> 'none' THEN album END, '') AS album
                   FROM cleaned WHERE NOT skipped AND lower(song_name) <> 'none'),
        texts AS (SELECT song_id, 'track:"' || song_name || '"' || coalesce(' artist:"' || artist || '"', '')
                         || coalesce(' album:"' || album || '"', '') AS strict,
                  concat_ws(' ', song_name, artist, album) AS loose FROM usable)
        SELECT song_id, 'A' AS service, 1::BIGINT AS strategy_no, strict AS query FROM texts
        UNION ALL SELECT song_id, 'A', 2, loose FROM texts UNION ALL SELECT song_id, 'B', 1, loose FROM texts""",
    ),
    "match_strategies_simple": with_views(
        "match_songs",
        f"""WITH {CLEANED_CTE.split('offers AS')[0].rstrip().rstrip(',')},
        texts AS (SELECT song_id, 'track:"' || song_name || '"' || coalesce(' artist:"' || nullif(artist, '') || '"', '') AS strict,
                  song_name || coalesce(' ' || nullif(artist, ''), '') AS loose FROM simple WHERE song_name IS NOT NULL)
        SELECT song_id, 'A' AS service, 1::BIGINT AS strategy_no, strict AS query FROM texts
        UNION ALL SELECT song_id, 'A', 2, loose FROM texts UNION ALL SELECT song_id, 'B', 1, loose FROM texts""",
    ),
    "link_match_a": _match(f"WITH {CLEANED_CTE}, {MATCH_A} SELECT * FROM match_a"),
    "link_match_b": _match(f"WITH {CLEANED_CTE}, {MATCH_B} SELECT * FROM match_b"),
    "link_match_simple": _match(
        f"WITH {CLEANED_CTE}, {SIMPLE_A}, {SIMPLE_B} SELECT * FROM simple_a UNION ALL SELECT * FROM simple_b"
    ),
    "link_failures": _match(
        f"""WITH {BOTH_CTE} SELECT c.song_id, c.song_name, c.artist, c.album, b.service
        FROM cleaned c JOIN both_services b ON b.song_id = c.song_id WHERE NOT c.skipped AND b.url IS NULL"""
    ),
    "link_summary": _match(
        f"""WITH {BOTH_CTE} SELECT service, (SELECT count(*) FROM cleaned) AS total,
        (SELECT count(*) FROM cleaned WHERE NOT skipped) AS saved, 0::BIGINT AS failed_saves,
        count(*) FILTER (url IS NULL) AS failed_fetches, count(url) AS links_found FROM both_services GROUP BY service"""
    ),
    "link_summary_narrow": _match(
        f"""WITH {BOTH_CTE}, {FITS_CTE} SELECT service, (SELECT count(*) FROM cleaned) AS total,
        (SELECT count(*) FROM cleaned WHERE NOT skipped) - count(*) FILTER (NOT fits) AS saved, count(*) FILTER (NOT fits) AS failed_saves,
        count(*) FILTER (url IS NULL) AS failed_fetches, count(url) FILTER (fits) AS links_found
        FROM both_services JOIN saves USING (song_id) GROUP BY service"""
    ),
    "link_save_narrow": with_views(
        "match_songs candidates song_links",
        f"""WITH {BOTH_CTE}, {FITS_CTE}, found AS (
          SELECT song_id, max(CASE WHEN service = 'A' THEN url END) AS spotify_url,
                 max(CASE WHEN service = 'B' THEN url END) AS youtube_music_url FROM both_services JOIN saves USING (song_id)
          WHERE fits GROUP BY song_id HAVING count(url) > 0) {_merged.format('found')}""",
    ),
    "link_save": with_views(
        "match_songs candidates song_links",
        f"""WITH {BOTH_CTE}, found AS (
          SELECT song_id, max(CASE WHEN service = 'A' THEN url END) AS spotify_url,
                 max(CASE WHEN service = 'B' THEN url END) AS youtube_music_url FROM both_services GROUP BY song_id
          HAVING count(url) > 0) {_merged.format('found')}""",
    ),
    "link_upsert": with_views(
        "song_links",
        f"""WITH {UPDATES_CTE}, given AS (SELECT * FROM updates WHERE coalesce(spotify_url, youtube_music_url) IS NOT NULL)
        {_merged.format('given')}""",
    ),
    "link_upsert_all": with_views("song_links", f"WITH {UPDATES_CTE} {_merged.format('updates')}"),
    "link_patch": with_views("song_links link_patch", f"WITH {PATCH_CTE} SELECT * FROM patched"),
    "link_coverage": with_views("song_links", _coverage("song_links")),
    "coverage_after_patch": with_views("song_links link_patch", f"WITH {PATCH_CTE} {_coverage('patched')}"),
    "text_strip": "SELECT conv_id, turn, regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS stripped FROM conversations",
}

_albums = lambda body: with_views("album_songs album_candidates", f"WITH {_albums_cte()} {body}")
ORACLES |= {
    "link_match_albums": _albums("SELECT * FROM both_services"),
    "link_failures_albums": _albums(
        """SELECT c.song_id, c.song_name, c.artist, c.album, b.service FROM cleaned c
        JOIN both_services b ON b.song_id = c.song_id AND b.album_key = c.album_key WHERE NOT c.skipped AND b.url IS NULL"""
    ),
    "link_summary_albums": _albums(
        """SELECT service, (SELECT count(*) FROM cleaned) AS total, (SELECT count(*) FROM cleaned WHERE NOT skipped) AS saved,
        0::BIGINT AS failed_saves, count(*) FILTER (url IS NULL) AS failed_fetches, count(url) AS links_found
        FROM cleaned c JOIN both_services b ON b.song_id = c.song_id AND b.album_key = c.album_key
        WHERE NOT c.skipped GROUP BY service"""
    ),
    "link_updates_albums": _albums(
        """SELECT song_id, arg_max(url, album_key) FILTER (service = 'A' AND url IS NOT NULL) AS spotify_url,
        arg_max(url, album_key) FILTER (service = 'B' AND url IS NOT NULL) AS youtube_music_url
        FROM both_services GROUP BY song_id"""
    ),
    "link_patch_times": with_views(
        "timed_links link_patch",
        """WITH cells AS (
          SELECT song_id, max(CASE WHEN link_column = 'spotify_url' THEN link_value END) AS sp,
                 max(CASE WHEN link_column = 'youtube_music_url' THEN link_value END) AS yt FROM link_patch GROUP BY song_id)
        SELECT l.song_id, coalesce(c.sp, spotify_url) AS spotify_url, coalesce(c.yt, youtube_music_url) AS youtube_music_url,
               CASE WHEN coalesce(c.sp, spotify_url, '') <> coalesce(spotify_url, '')
                      OR coalesce(c.yt, youtube_music_url, '') <> coalesce(youtube_music_url, '')
                    THEN '2024-05-06' ELSE '2020-01-02' END AS updated_on
        FROM timed_links l LEFT JOIN cells c ON c.song_id = l.song_id""",
    ),
}

ORACLES["link_stream"] = ORACLES["link_upsert"]
