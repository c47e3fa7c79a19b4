"""The corpus pipeline: five operators in a row over `documents`.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a
DataFrame: the columns of documents, or, from the last, the packed pieces. Every stage is written as
Parquet to the shared folder and read again before the next. Decisions take effect: toxic documents
go, documents the quality classifier rejects go, repeated lines go from the texts (n_chars follows;
a document whose lines are all gone stays with an empty text), one document stays of each group of
near duplicates (that with the smallest doc_id; of rows that share it, the first by hash of the text),
and all that is left is packed.

Null texts count as empty. Empty tables pass through every stage. Columns beyond those of documents
are dropped by the first stage. Labels of documents that are gone are not used.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.llm import kneser_ney, line_dedup, packing, simhash, toxicity  # noqa: E402
from cadenza.llm.common import table  # noqa: E402
from cadenza.session import new_path  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def keep_fluent(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return kneser_ney.keep_fluent(docs.select(*COLUMNS), trusted)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    text = F.col("kept_text")
    return short.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_fluent),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_each),
    ("best-fit packing", pack),
]

# Compression lengths, hashes and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
