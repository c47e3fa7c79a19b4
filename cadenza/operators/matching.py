"""Link matching: each song against ranked candidates of an outside service."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.artists import clean_artist, first_artist, first_artist_simple
from cadenza.functions.text import contains_either_way, none_word, strip
from cadenza.operators.skew import HOT_ROWS, hot_keys, join_many_to_one, join_one_to_many
from cadenza.session import cut

FALLBACK_TIER = 9


@dataclass(frozen=True)
class Rules:
    """What counts as a match for a service."""

    service: str
    uses_album: bool = True
    # A candidate without an album passes the album test of a song that names one.
    open_album: bool = True
    # Only candidates of type song can match; any type can be the fallback.
    songs_only: bool = False
    # Songs named none, in any case, are not searched.
    skips_none: bool = True
    # Candidates bring the id of a page instead of its address.
    gives_ids: bool = False


SERVICE_A = Rules("A")
SERVICE_B = Rules("B", open_album=False, songs_only=True, gives_ids=True)
SERVICE_A_SIMPLE = Rules("A", uses_album=False, skips_none=False)
SERVICE_B_SIMPLE = Rules("B", uses_album=False, songs_only=True, skips_none=False, gives_ids=True)
# The album that a candidate was searched for, where candidates are given per song and album.
SEARCHED_ALBUM = "searched_album"
ALBUM_KEY = "album_key"


def with_albums(songs: DataFrame, tracks: DataFrame, albums: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """songs LEFT JOIN tracks LEFT JOIN albums, adding album_name; popular keys are split."""
    of_song = tracks.select("song_id", "album_id")
    named = albums.select("album_id", F.col("name").alias("album_name"))
    with_name = join_many_to_one(of_song, named, ["album_id"], ["song_id"], "left", hot_rows)
    return join_one_to_many(songs, with_name, ["song_id"], ["album_id"], hot_rows).drop("album_id")


def match_input(
    songs: DataFrame,
    tracks: DataFrame,
    albums: DataFrame,
    limit: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Songs with the name of every album they are on; a limit takes the first by id."""
    rows = with_albums(songs.select("song_id", "song_name", "artists"), tracks, albums, hot_rows)
    return rows if limit is None else rows.orderBy("song_id", "album_name").limit(limit)


def clean_input(rows: DataFrame, simple: bool = False) -> DataFrame:
    """Parse the artist, tidy the names and mark rows without a usable song name.

    The simple job splits artists at commas, knows no albums and skips no row.
    """
    name = F.col("song_name")
    parsed = first_artist_simple(F.col("artists")) if simple else clean_artist(first_artist(F.col("artists")))
    skipped = F.lit(False) if simple else name.isNull() | (name == "") | (name == "None")
    return rows.select(
        "song_id",
        "song_name",
        parsed.alias("artist"),
        (F.lit(None).cast("string") if simple else strip(F.col("album_name"))).alias("album"),
        skipped.alias("skipped"),
    )


def searchable(name: Column, skips_none: bool = True) -> Column:
    return name.isNotNull() & (name != "") & ~none_word(name) if skips_none else name.isNotNull()


def search_texts(cleaned: DataFrame, skips_none: bool = True) -> DataFrame:
    """The query texts per song: (song_id, album, service, strategy_no, query).

    An artist or album that is empty is left out, and one named none too, unless that word
    has no meaning (skips_none=False).
    """
    def present(text: Column) -> Column:
        given = (text != "") & ~none_word(text) if skips_none else text != ""
        return F.when(F.coalesce(given, F.lit(False)), text)

    name, artist, album = F.col("song_name"), present(F.col("artist")), present(F.col("album"))
    strict = F.concat(
        F.lit('track:"'),
        name,
        F.lit('"'),
        F.coalesce(F.concat(F.lit(' artist:"'), artist, F.lit('"')), F.lit("")),
        F.coalesce(F.concat(F.lit(' album:"'), album, F.lit('"')), F.lit("")),
    )
    loose = F.concat_ws(" ", name, artist, album)

    def text(service: str, number: int, query: Column) -> Column:
        return F.struct(F.lit(service).alias("service"), F.lit(number).alias("strategy_no"), query.alias("query"))

    texts = F.array(text("A", 1, strict), text("A", 2, loose), text("B", 1, loose))
    rows = cleaned.filter(~F.col("skipped") & searchable(name, skips_none))
    return rows.select("song_id", "album", F.inline(texts))


def _plain(text: Column) -> Column:
    return strip(F.lower(text))


def album_key(album: Column) -> Column:
    """A missing album and an empty one are searched alike."""
    return F.coalesce(strip(album), F.lit(""))


def keyed(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, list[str]]:
    """rows with the key that links have: the song, or song and album."""
    if ALBUM_KEY not in links.columns:
        return rows, ["song_id"]
    return rows.withColumn(ALBUM_KEY, album_key(F.col("album"))), ["song_id", ALBUM_KEY]


def _judged(pairs: DataFrame, services: list[Rules], keys: list[str]) -> DataFrame:
    """What a candidate is worth to each service by name and artist; `offered` is its album if it is
    near. A pair is looked at once, for all services."""
    pairs = pairs.withColumn("plain_title", _plain(F.col("title")))
    name, title, artist = F.col("plain_name"), F.col("plain_title"), F.col("plain_artist")
    artists = F.coalesce("c_artists", F.array().cast("array<string>"))
    same = name == title
    artist_ok = (
        artist.isNull()
        | (artist == "")
        | F.exists(artists, lambda a: F.coalesce(contains_either_way(artist, _plain(a)), F.lit(False)))
    )
    alike = F.coalesce((same | contains_either_way(name, title)) & artist_ok, F.lit(False))
    offered = F.coalesce(_plain(F.col("c_album")), F.lit(""))
    pairs = pairs.withColumn("alike", alike).withColumn("same", F.coalesce(same, F.lit(False))).withColumn("offered", offered)

    def verdict(rules: Rules) -> Column:
        near = F.col("alike")
        if rules.songs_only:
            near = near & F.coalesce(F.col("result_type") == "song", F.lit(False))
        return F.struct(
            F.lit(rules.service).alias("service"),
            near.alias("near"),
            (near & F.col("same")).alias("same"),
            F.when(near & F.lit(rules.uses_album), F.col("offered")).alias("offered"),
        )

    verdicts = F.array(*map(verdict, services))
    if "c_service" in pairs.columns:
        verdicts = F.filter(verdicts, lambda v: v["service"] == F.col("c_service"))
    return pairs.select(*keys, "strategy_no", F.struct("pos", "title", "url").alias("place"), F.inline(verdicts))


def _tier(rules: Rules) -> Column:
    near, same, offered = F.col("near"), F.col("same"), F.col("offered")
    if not rules.uses_album:
        return F.when(near, 1).otherwise(FALLBACK_TIER)
    wanted = _plain(F.col("album"))
    fits = contains_either_way(wanted, offered)
    if not rules.open_album:
        fits = fits & (offered != "")
    album_ok = wanted.isNull() | (wanted == "") | fits
    return F.when(near & album_ok & same, 1).when(near & album_ok, 2).when(near, 3).otherwise(FALLBACK_TIER)


def match_links(
    cleaned: DataFrame, candidates: DataFrame, rules: Rules | Sequence[Rules], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(song_id, service, url, tier, strategy_no, pos, title): the best candidate of every song, for
    one service or, in one pass over the candidates, for several that search the same names.

    The first search strategy with results counts. Within it the best tier wins, then the
    earliest place; a candidate that fits no tier is the fallback. A song on several albums is
    compared with each and keeps its best tier: all albums share the song's candidates, hence
    its first strategy. Songs without a candidate have a null url.

    Candidates are never collected per song. They are judged by name and artist where the join
    left them and reduced there to the earliest one per outcome and offered album, so that the
    album test sees different album names only.

    Where candidates say which album they were searched for (searched_album), every song and album
    is matched by its own candidates, and the result has one row for each, with album_key.
    """
    services = [rules] if isinstance(rules, Rules) else list(rules)
    if len({r.skips_none for r in services}) != 1 or len({r.service for r in services}) != len(services):
        raise ValueError("services of one pass differ, and search the same names")
    rows = cleaned.filter(~F.col("skipped"))
    own_service = []
    if "service" in candidates.columns:
        candidates = candidates.filter(F.col("service").isin([r.service for r in services]))
        own_service = [F.col("service").alias("c_service")]
    by_album = SEARCHED_ALBUM in candidates.columns
    keys = ["song_id", ALBUM_KEY] if by_album else ["song_id"]
    if by_album:
        rows = rows.withColumn(ALBUM_KEY, album_key(F.col("album")))
        candidates = candidates.withColumn(ALBUM_KEY, album_key(F.col(SEARCHED_ALBUM)))
    plain_names = [_plain(F.col(c)).alias(n) for c, n in (("song_name", "plain_name"), ("artist", "plain_artist"))]
    names = rows.filter(searchable(F.col("song_name"), services[0].skips_none)).select(*keys, *plain_names).distinct()
    offers = candidates.select(
        *keys,
        "strategy_no",
        "pos",
        "title",
        F.col("artists").alias("c_artists"),
        F.col("album").alias("c_album"),
        "result_type",
        "url",
        *own_service,
    )
    # Written, as it is asked for several times. Without a popular key nothing is split, so candidates
    # are shuffled by song once, and all that follows happens where they then are.
    hot = cut(hot_keys(offers.filter(F.col("song_id").isNotNull()), keys, hot_rows))
    split = not hot.isEmpty()
    pairs = join_many_to_one(offers, names, keys, ["url", "pos"], "inner", hot=hot) if split else offers.join(names, keys)
    outcome = [*keys, "service", "strategy_no", "near", "same", "offered"]
    judged = _judged(pairs, services, keys).groupBy(*outcome).agg(F.min("place").alias("place"))
    if by_album:
        judged = judged.withColumn("album", F.col(ALBUM_KEY))
    elif any(r.uses_album for r in services):
        # Only near candidates look at albums; the others have a null album and stay as they are.
        albums = rows.select(F.col("song_id").alias("album_of"), "album").distinct()
        if split:
            judged = judged.withColumn("album_of", F.when(F.col("near"), F.col("song_id")))
            popular = hot.withColumnRenamed("song_id", "album_of")
            judged = join_many_to_one(judged, albums, ["album_of"], ["offered", "song_id"], "left", hot=popular)
        else:
            judged = judged.join(albums, (F.col("song_id") == F.col("album_of")) & F.col("near"), "left")

    def best_of(rules: Rules) -> Column:
        mine = F.struct("strategy_no", _tier(rules).alias("tier"), "place")
        return F.min(F.when(F.col("service") == rules.service, mine)).alias(f"best_{rules.service}")

    def result(rules: Rules) -> Column:
        best = F.col(f"best_{rules.service}")
        place = best["place"]
        return F.struct(
            F.lit(rules.service).alias("service"),
            (watch_address(place["url"]) if rules.gives_ids else place["url"]).alias("url"),
            best["tier"].alias("tier"),
            best["strategy_no"].alias("strategy_no"),
            place["pos"].alias("pos"),
            place["title"].alias("title"),
        )

    # One row per key holds the best of every service until the end, so that the join is by key alone.
    best = judged.groupBy(*keys).agg(*map(best_of, services))
    met = rows.select(*keys).distinct().join(best, keys, "left")
    return met.select(*keys, F.inline(F.array(*map(result, services))))


def link_updates(links: DataFrame) -> DataFrame:
    """(song_id, spotify_url, youtube_music_url) from the matches of one or both services.

    A service that was not run leaves its column null, so the stored link stays. Of a song matched
    per album, the link of the last album counts, albums in order of their names.
    """
    found = (F.col(ALBUM_KEY) if ALBUM_KEY in links.columns else F.lit("")).alias(ALBUM_KEY)

    def url(service: str) -> Column:
        given = (F.col("service") == service) & F.col("url").isNotNull()
        return F.max(F.when(given, F.struct(found, "url")))["url"]

    return links.groupBy("song_id").agg(url("A").alias("spotify_url"), url("B").alias("youtube_music_url"))


# Fixed value: the page of a service B song, before its id.
WATCH = "https://music.youtube.com/watch?v="


def watch_address(video_id: Column) -> Column:
    return F.concat(F.lit(WATCH), video_id)


def link_failures(
    cleaned: DataFrame, links: DataFrame, run_at: datetime | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Songs of the input without a link, per service, with the time of the run if given."""
    rows, keys = keyed(cleaned.filter(~F.col("skipped")), links)
    services = links.filter(F.col("url").isNull()).select(*keys, "service")
    rows = join_many_to_one(rows, services, keys, ["album"], "inner", hot_rows)
    when = [] if run_at is None else [F.lit(run_at).cast("timestamp").alias("timestamp")]
    return rows.select("song_id", "song_name", "artist", "album", "service", *when)


def link_summary(cleaned: DataFrame, links: DataFrame) -> DataFrame:
    """Per service: rows read, rows saved, failed saves, rows without a link, rows with one.

    All are counted in rows of the input. Rows without a usable name count as read but are neither
    saved nor failed. Equal keys of the input are counted first, so that none gathers rows.
    """
    total = cleaned.agg(F.count(F.lit(1))).scalar()
    saved = cleaned.agg(F.count_if(~F.col("skipped"))).scalar()
    rows, keys = keyed(cleaned.filter(~F.col("skipped")), links)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(links.select(*keys, "service", "url"), keys)
    found = met.groupBy("service").agg(
        F.coalesce(F.sum(F.when(F.col("url").isNull(), F.col("n"))), F.lit(0)).alias("failed_fetches"),
        F.coalesce(F.sum(F.when(F.col("url").isNotNull(), F.col("n"))), F.lit(0)).alias("links_found"),
    )
    return found.select(
        "service",
        total.alias("total"),
        saved.alias("saved"),
        F.lit(0).cast("long").alias("failed_saves"),
        "failed_fetches",
        "links_found",
    )
