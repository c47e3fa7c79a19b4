"""Embedding job: text assembly, clipping, and a model hook called batch by batch."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import clip_words, embedding_text
from cadenza.operators.catalog import join_ignoring_case
from cadenza.operators.skew import HOT_ROWS, join_many_to_one, join_one_to_many
from cadenza.session import send_with_tasks

send_with_tasks(__name__)

# Texts per model call, and words kept per song.
BATCH_SIZE = 25
MAX_WORDS = 400

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]


def song_texts(songs: DataFrame, lyrics: DataFrame, ignore_case: bool = True) -> DataFrame:
    """(song_id, text): chart note and lyrics of every song."""
    notes = songs.select(F.col("song_id").cast("string").alias("song_id"), "billboard")
    words = lyrics.select(F.col("song_id").cast("string").alias("song_id"), "lyrics")
    if ignore_case:
        joined = join_ignoring_case(notes, words, "song_id", HOT_ROWS)
    else:
        joined = join_one_to_many(notes, words, ["song_id"], ["lyrics"])
    return joined.select("song_id", embedding_text(F.col("billboard"), F.col("lyrics")).alias("text"))


def clip_texts(texts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    return texts.withColumn("text", clip_words(F.col("text"), max_words))


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")


def hashed_words(dims: int = 64) -> Embedder:
    """Offline stand-in for a model: signed counts of hashed words, scaled to length 1."""
    known: dict[str, int] = {}

    def code(word: str) -> int:
        if word not in known:
            if len(known) >= 200_000:
                known.clear()
            known[word] = _word_hash(word)
        return known[word]

    def one(text: str) -> np.ndarray:
        codes = np.array([code(w) for w in re.findall(r"\w+", text.lower())], dtype=np.uint64)
        signs = np.where(codes >> np.uint64(63), 1.0, -1.0)
        vector = np.bincount((codes % np.uint64(dims)).astype(np.int64), signs, dims)
        length = np.linalg.norm(vector)
        return (vector / length if length else vector).astype("float32")

    def embed(texts: Sequence[str]) -> list[np.ndarray]:
        return [one(t) for t in texts]

    return embed


def embed_texts(texts: DataFrame, embedder: Embedder, batch_size: int = BATCH_SIZE) -> DataFrame:
    """(song_id, embedding, error): the hook is called on batch_size texts at a time.

    If a call fails, its whole batch gets null vectors and the reason.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                vectors, error = [None] * len(part), None
                try:
                    given = list(embedder(part["text"].tolist()))
                    if len(given) != len(part):
                        raise ValueError(f"{len(given)} vectors for {len(part)} texts")
                    vectors = given
                except Exception as problem:  # the hook is foreign code
                    error = f"{type(problem).__name__}: {problem}"
                yield pd.DataFrame({"song_id": part["song_id"].to_numpy(), "embedding": vectors, "error": error})

    return texts.select("song_id", "text").mapInPandas(run, "song_id string, embedding array<float>, error string")


def embed_prompts(queries: DataFrame, embedder: Embedder, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Fill queries.vec; every distinct prompt is embedded once. A missing prompt has no vector."""
    prompts = queries.filter(F.col("prompt").isNotNull()).select(F.col("prompt").alias("song_id"), F.col("prompt").alias("text")).distinct()
    vectors = embed_texts(prompts, embedder, batch_size)
    vectors = vectors.select(F.col("song_id").alias("prompt"), F.col("embedding").alias("vec"))
    return join_many_to_one(queries.drop("vec"), vectors, ["prompt"], ["query_id"])
