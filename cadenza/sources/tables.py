"""Table schemas, dump and restore, and metadata listing."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "songs": "song_id string, song_name string, artists string, popularity int, song_type string, billboard string",
    "lyrics": "song_id string, lyrics string",
    "embeddings": "song_id string, embedding array<float>, created_at timestamp, updated_at timestamp",
    "artists": "artist_id string, name string, artist_type string, main_genre string, genres string, image_url string",
    "acoustic_features": "song_id string, energy float",
    "tracks": "song_id string, album_id string, release_date string",
    "albums": "album_id string, name string",
    "song_links": "song_id string, spotify_url string, youtube_music_url string, apple_music_url string, "
    "created_at timestamp, updated_at timestamp",
    "user_playlists": "id long, user_id string, playlist_name string, song_data string, "
    "created_at timestamp, updated_at timestamp",
}


def ensure_table(spark: SparkSession, table: str, name: str, path: str) -> DataFrame:
    """The catalogue table `name`, created empty at path with the schema of SCHEMAS[table] if missing."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in T.StructType.fromDDL(SCHEMAS[table]))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}'")
    return spark.table(name)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: str, high: str, partitions: int, **options: str
) -> DataFrame:
    """A relational table read in parallel ranges of a numeric or date key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    bounds = {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": str(partitions)}
    return reader.options(**bounds).load()


def dump_table(df: DataFrame, path: str, structure: bool = True, data: bool = True) -> None:
    """Write a table's schema, its rows, or both."""
    if structure:
        schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string")
        schema.coalesce(1).write.mode("overwrite").text(f"{path}/structure")
    if data:
        df.write.mode("overwrite").parquet(f"{path}/data")


def write_clustered(df: DataFrame, path: str, by: list[str], files: int) -> None:
    """Write df in ranges of `by`, so that a filter on its first columns reads few files.

    End `by` with a column that differs between rows: a very common first value then spans
    several files instead of filling one.
    """
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def read_structure(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(spark.read.text(f"{path}/structure").first()["value"]))


def restore_table(spark: SparkSession, path: str) -> DataFrame:
    """A dumped table with its rows, or an empty one if only the structure was dumped."""
    schema = read_structure(spark, path)
    try:
        return spark.read.schema(schema).parquet(f"{path}/data")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_tables(spark: SparkSession, like: str | None = None) -> DataFrame:
    """(namespace, tableName, isTemporary) of the current database."""
    found = spark.sql("SHOW TABLES")
    return found.filter(F.col("tableName").like(like)) if like else found


def column_status(df: DataFrame) -> DataFrame:
    """(col_name, data_type, n_given, n_rows): every column, its type, and how often it has a value."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(name).alias("col_name"), F.lit(kind).alias("data_type"), F.col(f"n_{i}").alias("n_given"))
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counted.select("n_rows", F.inline(F.array(*rows))).select("col_name", "data_type", "n_given", "n_rows")


def list_databases(spark: SparkSession, like: str | None = None) -> DataFrame:
    """(namespace) of the databases that the catalogue knows."""
    found = spark.sql("SHOW DATABASES")
    return found.filter(F.col("namespace").like(like)) if like else found


def describe_table(spark: SparkSession, name: str, extended: bool = False) -> DataFrame:
    """Columns and types; extended adds what the catalogue knows of the table itself."""
    return spark.sql(f"DESCRIBE TABLE {'EXTENDED ' if extended else ''}{name}")
