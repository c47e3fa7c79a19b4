from pyspark.sql import functions as F

from cadenza.operators import embedding as em


def test_song_texts(spark, rows):
    songs = spark.createDataFrame([("A", "chart"), ("b", None), ("c", "")], "song_id string, billboard string")
    lyrics = spark.createDataFrame([("a", "la"), ("b", "lo")], "song_id string, lyrics string")
    assert rows(em.song_texts(songs, lyrics)) == [("A", "chart\n\nla"), ("b", "lo"), ("c", "")]
    assert rows(em.song_texts(songs, lyrics, ignore_case=False))[0] == ("A", "chart\n\n")


def test_hook_sees_batches_and_every_text(spark):
    texts = spark.range(0, 103, 1, 2).select(F.col("id").cast("string").alias("song_id"), F.concat(F.lit("word"), "id").alias("text"))

    def sizes(batch):
        return [[float(len(batch))]] * len(batch)

    got = em.embed_texts(texts, sizes, batch_size=25).collect()
    assert len(got) == 103 and {r.embedding[0] for r in got} <= {25.0, 1.0, 2.0} and all(r.error is None for r in got)


def test_failed_batch_gives_nulls_with_a_reason(spark):
    texts = spark.createDataFrame([(str(i), "bad" if i == 3 else "ok") for i in range(8)], "song_id string, text string").coalesce(1)

    def picky(batch):
        if "bad" in batch:
            raise RuntimeError("refused")
        return [[1.0]] * len(batch)

    got = {r.song_id: r for r in em.embed_texts(texts, picky, batch_size=4).collect()}
    assert [i for i in sorted(got) if got[i].embedding is None] == ["0", "1", "2", "3"]
    assert got["0"].error == "RuntimeError: refused" and got["7"].error is None
    short = em.embed_texts(texts, lambda batch: [[1.0]], batch_size=8).collect()
    assert all(r.embedding is None and r.error.startswith("ValueError") for r in short)


def test_offline_embedder_is_deterministic_and_unit(spark):
    embed = em.hashed_words(16)
    a, b, empty = embed(["One two, two", "one TWO two", ""])
    a, b, empty = a.tolist(), b.tolist(), empty.tolist()
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and not any(empty)


def test_every_distinct_prompt_is_embedded_once(spark):
    queries = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None)], "query_id int, prompt string, vec array<float>")
    got = em.embed_prompts(queries, em.hashed_words(8)).collect()
    vectors = {r.query_id: r.vec for r in got}
    assert len(got) == 3 and vectors[1] == vectors[2] and all(vectors.values())


def test_a_missing_prompt_does_not_spoil_its_batch(spark):
    queries = spark.createDataFrame([(1, "good words", None), (2, None, None)], "query_id int, prompt string, vec array<float>")
    got = {r.query_id: r.vec for r in em.embed_prompts(queries, em.hashed_words(8)).collect()}
    assert got[1] and got[2] is None


def test_functions_travel_without_the_package(tmp_path):
    """A task finds everything it calls, also where this package is not installed."""
    import subprocess
    import sys

    import numpy as np
    import pyarrow as pa
    from pyspark import cloudpickle

    from cadenza.operators import knn

    out = pa.schema([("query_id", pa.int64()), ("song_id", pa.string()), ("score", pa.float64())])
    parts = {
        "embed": em.hashed_words(8),
        "stream": knn._best_of_stream([1], np.ones((1, 2)), 3, out),
    }
    (tmp_path / "parts").write_bytes(cloudpickle.dumps(parts))
    code = (
        "import pickle, pyarrow as pa; p = pickle.load(open('parts', 'rb')); p['embed'](['a b']);"
        "b = pa.RecordBatch.from_pydict({'song_id': ['x'], 'embedding': [[1.0, 2.0]]}); assert list(p['stream']([b]))"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
