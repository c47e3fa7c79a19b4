"""Inputs shared by the registered queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cadenza.operators.catalog import build_catalog, build_documents
from cadenza.operators.index import Index
from cadenza.operators.lexical import with_suggested_keywords
from cadenza.session import cut, new_path
from cadenza.sources import clustered, name_index
from cadenza.sources.catalog_views import base_table, view
from cadenza.sources.index_store import buckets_for, save_index

DIMS = 64
# Keywords per registered query, as many as the model is asked for.
KEYWORDS = 10


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six tables of the catalogue join."""
    names = {
        "songs": "songs",
        "lyrics": "lyrics",
        "embeddings": "song_embeddings",
        "links": "song_links",
        "artists": "artists",
        "features": "acoustic_features",
    }
    return {key: view(spark, sf_dir, name) for key, name in names.items()}


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_catalog(tables(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_documents(tables(spark, sf_dir), DIMS)


@dataclass(frozen=True)
class SearchInputs:
    index: Index
    queries: DataFrame


_built: dict[tuple[str, str], SearchInputs] = {}


def search_inputs(spark: SparkSession, sf_dir: str) -> SearchInputs:
    """The stored index and the query batch, built once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        path = new_path(spark, "index")
        name = "cadenza_" + path.rsplit("-", 1)[1]
        # No more documents than vectors.
        buckets = buckets_for(spark, base_table(spark, sf_dir, "embeddings").count())
        index = save_index(documents(spark, sf_dir), name, path, buckets)
        queries = view(spark, sf_dir, "queries")
        queries = cut(with_suggested_keywords(index, queries, KEYWORDS))
        _built[key] = SearchInputs(index, queries)
    return _built[key]


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table that the index is made from."""
    return search_inputs(spark, sf_dir).index.documents


_laid_out: dict[tuple[str, ...], str] = {}


def documents_by_value(spark: SparkSession, sf_dir: str) -> str:
    """Where the documents lie by energy and popularity, written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "values")
    if key not in _laid_out:
        path = new_path(spark, "values")
        rows = documents(spark, sf_dir)
        files = clustered.files_for(spark, base_table(spark, sf_dir, "embeddings").count())
        clustered.save_by_values(cut(rows), path, ["energy", "popularity"], "song_id", files)
        _laid_out[key] = path
    return _laid_out[key]


def named_songs(spark: SparkSession, sf_dir: str, fold: str) -> str:
    """Where the songs lie with the index of their names, written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, fold)
    if key not in _laid_out:
        path = new_path(spark, "names")
        name_index.save_names(view(spark, sf_dir, "songs"), path, fold)
        _laid_out[key] = path
    return _laid_out[key]
