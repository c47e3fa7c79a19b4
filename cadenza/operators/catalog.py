"""Catalogue denormalisation: one search document per song."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import collation_key, first_quoted
from cadenza.functions.vectors import norm, parse_vector
from cadenza.operators.skew import HOT_ROWS, hot_keys, join_many_to_one, join_one_to_many, one_per_key

DOCUMENT_COLUMNS = (
    "song_id song_name lyrics popularity song_type artist_id name_artists artist_type "
    "main_genre genres image_url spotify_url embedding energy"
).split()
# Ids are sent to every task only up to so many rows and bytes, with so many per row besides the id.
SMALL_ROWS = 2_000_000
SMALL_BYTES = 64 << 20
ROW_BYTES = 64


def join_ignoring_case(left: DataFrame, right: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame:
    """Left join on a key whose letter case, accents and blanks at the end do not matter; keeps the key
    of the left side.

    With hot_rows, keys with more rows than that on the right are split.
    """
    keyed_left = left.withColumn("__key", collation_key(F.col(key)))
    keyed_right = right.withColumn("__key", collation_key(F.col(key))).drop(key)
    if hot_rows is None:
        return keyed_left.join(keyed_right, "__key", "left").drop("__key")
    row_key = [c for c in keyed_right.columns if c != "__key"]
    return join_one_to_many(keyed_left, keyed_right, ["__key"], row_key, hot_rows).drop("__key")


def join_artist(
    songs: DataFrame, artists: DataFrame, hot_rows: int = HOT_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Attach the artist whose id is the first quoted token of songs.artists.

    An artist may hold a large share of all songs, so its songs are spread over several tasks.
    Artists are counted in `counted`, a table that holds all of songs, if that is cheaper.
    """
    key = first_quoted(F.col("artists")).alias("artist_key")
    named = artists.select(
        F.col("artist_id").alias("artist_key"),
        "artist_id",
        F.col("name").alias("name_artists"),
        "artist_type",
        "main_genre",
        "genres",
        "image_url",
    )
    keys = (songs if counted is None else counted).select(key).filter("artist_key IS NOT NULL")
    hot = hot_keys(keys, ["artist_key"], hot_rows)
    return join_many_to_one(songs.select("*", key), named, ["artist_key"], ["song_id"], hot=hot)


def _sides(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    text_id = F.col("song_id").cast("string").alias("song_id")
    embeddings = tables["embeddings"]
    if embeddings.schema["embedding"].dataType.simpleString() == "string":
        embeddings = embeddings.withColumn("embedding", parse_vector(F.col("embedding")))
    features = tables["features"]
    if features.schema["energy"].dataType.simpleString() == "string":
        features = features.withColumn("energy", F.col("energy").try_cast("double"))
    return {
        "songs": tables["songs"].select(text_id, "song_name", "artists", "popularity", "song_type"),
        "lyrics": tables["lyrics"].select(text_id, "lyrics"),
        "embeddings": embeddings.select(text_id, "embedding"),
        "links": tables["links"].select(text_id, "spotify_url"),
        "features": features.select(text_id, "energy"),
        "artists": tables["artists"],
    }


def build_catalog(
    tables: dict[str, DataFrame],
    one_row_per_song: bool = False,
    ignore_case: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left-join songs with lyrics, embeddings, links, artists and features.

    Repeated ids fan out as in any join, and an id with very many rows is split. With
    one_row_per_song every side is first reduced to its smallest row per id. The sides multiply
    independently, so this equals keeping the smallest row of the fanned-out result, without
    ever building it. Lyrics, the largest side, are reduced by the key they are joined on, so they
    are shuffled once.
    """
    side = _sides(tables)
    all_songs = side["songs"]
    if one_row_per_song:
        by_id = {n: df for n, df in side.items() if n != "lyrics"}
        side |= {n: one_per_key(df, "artist_id" if n == "artists" else "song_id") for n, df in by_id.items()}
    joined = join_artist(side["songs"], side["artists"], hot_rows, all_songs).drop("artist_key")
    values = {"links": "spotify_url", "features": "energy", "embeddings": "embedding", "lyrics": "lyrics"}
    for name, value in values.items():
        right = side[name]
        if name == "lyrics" and one_row_per_song:
            key = collation_key(F.col("song_id")) if ignore_case else F.col("song_id")
            right = one_per_key(right.select(key.alias("__key"), value), "__key")
            joined = joined.withColumn("__key", key).join(right, "__key", "left").drop("__key")
        elif name == "lyrics" and ignore_case:
            joined = join_ignoring_case(joined, right, "song_id", hot_rows)
        elif one_row_per_song:
            joined = joined.join(right, "song_id", "left")
        else:
            joined = join_one_to_many(joined, right, ["song_id"], [value], hot_rows)
    return joined.select(
        "song_id",
        "song_name",
        F.col("artists").alias("s_artists"),
        "spotify_url",
        F.col("popularity").try_cast("int").alias("popularity"),
        "song_type",
        "lyrics",
        "embedding",
        "artist_id",
        "name_artists",
        "artist_type",
        "main_genre",
        "genres",
        "image_url",
        "energy",
    )


def check_documents(catalog: DataFrame, dims: int) -> DataFrame:
    """Add `reason`: why a row cannot be indexed, null for an accepted row."""
    vector = F.col("embedding")
    reason = (
        F.when(vector.isNull(), "missing_embedding")
        .when(F.col("song_id").isNull() | (F.col("song_id") == ""), "empty_song_id")
        .when(F.size(vector) != dims, "bad_dims")
        .when(F.coalesce(norm(vector), F.lit(0.0)) == 0, "zero_norm")
    )
    return catalog.withColumn("reason", reason)


def _of_embedded(tables: dict[str, DataFrame], ignore_case: bool) -> dict[str, DataFrame]:
    """The tables without rows of songs that have no vector and so make no document.

    Rows go where they are read, before anything is shuffled. Too many ids to send to every task
    leave the tables whole, which gives the same documents.
    """
    text_id = F.col("song_id").cast("string")
    ids = tables["embeddings"].select(text_id.alias("__id"))
    size = ids.agg(F.count("__id").alias("n"), F.sum(F.octet_length("__id") + ROW_BYTES).alias("bytes")).first()
    if size["n"] > SMALL_ROWS or (size["bytes"] or 0) > SMALL_BYTES:
        return tables

    def kept(name: str) -> DataFrame:
        alike = collation_key if name == "lyrics" and ignore_case else lambda value: value
        wanted = ids.select(alike(F.col("__id")).alias("__id"))
        return tables[name].join(F.broadcast(wanted), alike(text_id) == F.col("__id"), "left_semi")

    return tables | {name: kept(name) for name in ("songs", "lyrics", "links", "features")}


def build_documents(tables: dict[str, DataFrame], dims: int, ignore_case: bool = True) -> DataFrame:
    """One accepted document per song; songs without a vector, and vectors that cannot be indexed,
    are left out first."""
    embeddings = _sides(tables)["embeddings"]
    usable = check_documents(embeddings, dims).filter("reason IS NULL").drop("reason")
    tables = _of_embedded(tables, ignore_case)
    catalog = build_catalog({**tables, "embeddings": usable}, True, ignore_case)
    return accepted_documents(catalog, dims)


def accepted_documents(catalog: DataFrame, dims: int) -> DataFrame:
    return check_documents(catalog, dims).filter("reason IS NULL").select(*DOCUMENT_COLUMNS)


def index_outcomes(tables: dict[str, DataFrame], dims: int, ignore_case: bool = True) -> DataFrame:
    """(song_id, reason, n_rows): what becomes of the rows of the fanned-out catalogue.

    The sides multiply independently, so rows are counted per song and side and the counts
    multiplied; the catalogue itself is not built. A null reason means accepted.
    """
    side = _sides(tables)

    def counted(df: DataFrame, *keys) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))

    songs = side["songs"].select("song_id", first_quoted(F.col("artists")).alias("artist_key"))
    names = counted(side["artists"], F.col("artist_id").alias("artist_key"))
    named = join_many_to_one(songs, names, ["artist_key"], ["song_id"])
    rows = named.groupBy("song_id").agg(F.sum(F.coalesce("n_rows", F.lit(1))).alias("n"))
    vectors = side["embeddings"].withColumn("present", F.lit(True))
    checked = counted(check_documents(vectors, dims), "song_id", "reason")
    rows = rows.join(checked.withColumn("present", F.lit(True)), "song_id", "left")
    n = F.col("n") * F.coalesce("n_rows", F.lit(1))
    reason = F.when(F.col("present"), F.col("reason")).otherwise("missing_embedding")
    rows = rows.select("song_id", reason.alias("reason"), n.alias("n"))
    for name in ("links", "features", "lyrics"):
        key = collation_key(F.col("song_id")) if name == "lyrics" and ignore_case else F.col("song_id")
        right = counted(side[name], key.alias("__key"))
        rows = rows.withColumn("__key", key).join(right, "__key", "left")
        rows = rows.select("song_id", "reason", (F.col("n") * F.coalesce("n_rows", F.lit(1))).alias("n"))
    return rows.groupBy("song_id", "reason").agg(F.sum("n").alias("n_rows"))


def rejected_documents(tables: dict[str, DataFrame], dims: int) -> DataFrame:
    """(song_id, reason, n_rows) of the rows that cannot be indexed."""
    return index_outcomes(tables, dims).filter("reason IS NOT NULL")


def index_summary(tables: dict[str, DataFrame], dims: int) -> DataFrame:
    """Number of rows per outcome."""
    status = F.when(F.col("reason").isNull(), "indexed").otherwise("rejected").alias("status")
    return (
        index_outcomes(tables, dims)
        .select(status, F.coalesce("reason", F.lit("")).alias("reason"), "n_rows")
        .groupBy("status", "reason")
        .agg(F.sum("n_rows").alias("n_rows"))
    )
