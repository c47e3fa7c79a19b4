import random
import zlib

import numpy as np
import pytest
import zstandard

from cadenza.llm import toxicity as tx
from tests.llm import cases

LABELS = "doc_id long, toxic int, quality int"


def corpus(seed=1, n=400):
    """Invented words; every fourth text has some of a few words that the others never have."""
    rng = random.Random(seed)
    syllables = ["ta", "re", "mo", "li", "sun", "ker", "po", "vi", "dan", "esh"]
    bad = ["grumblor", "snarkfitz", "wuzzlebob", "krakzen", "plixory"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 120))]
        if toxic:
            for _ in range(rng.randint(3, 8)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words).capitalize(), "en", "s", 0))
        labels.append((i, int(toxic), 1))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    marks = tx.learn_labels(spark.createDataFrame(labels, LABELS))
    return tx.train(cases.frame(spark, rows), marks)


def test_held_out_accuracy(spark, model):
    rows, labels = corpus()
    scores = {r.doc_id: r.toxicity for r in tx.scored(cases.frame(spark, rows), model).collect()}
    held = [(scores[i], toxic) for i, toxic, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50
    assert sum((s >= 0.5) == bool(t) for s, t in held) >= 0.95 * len(held)
    fresh, known = corpus(seed=2, n=200)
    new = {r.doc_id: r.toxicity for r in tx.scored(cases.frame(spark, fresh), model).collect()}
    assert sum((new[i] >= 0.5) == bool(t) for i, t, _ in known) >= 190


def test_held_out_rows_are_not_learned_from(spark):
    marks = tx.learn_labels(spark.createDataFrame([(i, 0, 1) for i in range(200)] + [(None, 1, 1)], LABELS))
    assert {r.doc_id for r in marks.collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5} | {None}


def test_awkward_documents(spark, model):
    rows = cases.documents()
    df = cases.frame(spark, rows)
    found = tx.scored(df, model)
    assert found.columns == [c for c in df.columns if c != "toxicity"] + ["toxicity"]
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.toxicity <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(r.toxicity)
    assert all(len(s) == 1 for s in by_text.values())
    assert tx.scored(cases.frame(spark, []), model).count() == 0


def test_scores_do_not_depend_on_what_a_worker_keeps(model, monkeypatch):
    monkeypatch.setattr(tx, "KEPT_WORDS", 3)
    small, large = (tx.Lengths(model.ordinary, model.toxic, model.phrases) for _ in range(2))
    for _, text, *_ in cases.documents() + corpus()[0][:40]:
        data = (text or "").encode()
        monkeypatch.setattr(tx, "KEPT_WORDS", 3)
        a = small.counts(data)
        monkeypatch.setattr(tx, "KEPT_WORDS", 10**9)
        assert np.array_equal(a, large.counts(data))


def test_lengths_and_score_by_the_definition(model):
    """The same numbers without what a worker keeps, window by window."""
    lengths = tx.Lengths(model.ordinary, model.toxic, model.phrases)
    trained, _, added = model.toxic.rpartition(b"\n")
    known = {}

    def size(content, window, narrow):
        if (content, narrow) not in known:
            shape = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_BTLAZY2 if narrow else zstandard.STRATEGY_FAST, min_match=4, window_log=17,
                hash_log=17, chain_log=17, search_log=8 if narrow else 1, write_checksum=0, write_content_size=0, write_dict_id=0,
            )
            kind = zstandard.DICT_TYPE_RAWCONTENT if narrow else zstandard.DICT_TYPE_AUTO
            held = zstandard.ZstdCompressionDict(content, dict_type=kind)
            held.precompute_compress(compression_params=shape)
            known[content, narrow] = zstandard.ZstdCompressor(dict_data=held, compression_params=shape)
        return len(known[content, narrow].compress(window))

    starts = [int((len(model.ordinary) - 2 * tx.CONTEXT) * place) for place in tx.CONTEXTS]
    contexts = [model.ordinary[at : at + tx.CONTEXT] for at in starts]
    half = tx.CONTEXT // 2
    words = (b"takerpo grumblor sunmo snarkfitz vi dan po " * 9).split()
    counts = np.zeros(tx.KINDS[1].stop, dtype=int)
    for word in words:
        dictionaries = (model.ordinary, model.ordinary + added)
        a, b = (sum(size(d, c[:half] + b" " + word + b" " + c[half:], True) for c in contexts) for d in dictionaries)
        a, b = (min(max(n - base, 0), tx.CELLS - 1) for n, base in zip((a, b), lengths.base))
        counts[a * tx.CELLS + b] += 1
    for at in range(0, len(words), tx.WIDE_WORDS):
        window = b" ".join(words[at : at + tx.WIDE_WORDS])
        saved = size(model.ordinary, window, False) - size(trained, window, False)
        counts[tx.CELLS**2 + min(max(saved + tx.SAVED, 0), 2 * tx.SAVED - 1)] += 1
    assert np.array_equal(lengths.counts(b"Takerpo GRUMBLOR, sunmo! snarkfitz vi dan po\n" * 9), counts)
    x = []
    for kind in tx.KINDS:
        ratios = np.repeat(model.ratios[kind], counts[kind])
        n = len(ratios)
        x += [ratios.mean(), ratios.sum() / n**0.5, *(np.log1p((ratios > s).sum()) for s in tx.STEPS), np.log1p(n)]
    score = 1 / (1 + np.exp(-(model.weights[0] + ((np.array(x) - model.means) / model.scales) @ model.weights[1:])))
    assert abs(tx.score_of(model, counts) - score) < 1e-9


def test_windows_cover_whole_texts():
    text = ("Word, " * 300_000 + "x" * 100).encode()
    words = [w for part, _ in tx.windows(text) for w in part]
    assert words[:300_000] == [b"word"] * 300_000 and b"".join(words[300_000:]) == b"x" * 100


def test_without_labels_of_both_kinds(spark):
    rows, labels = corpus(n=40)
    df = cases.frame(spark, rows)
    for marks, share in (([], 0.0), ([(i, 1, 1) for i in range(5)], 1.0), ([(i, 0, 1) for i in range(5)], 0.0), ([(999, 1, 0), (None, 1, 1)], 0.0)):
        model = tx.train(df, spark.createDataFrame(marks, LABELS))
        assert {r.toxicity for r in tx.scored(df, model).collect()} == {share}
    assert tx.scored(df, tx.train(cases.frame(spark, []), spark.createDataFrame(labels, LABELS))).count() == 40


def test_samples_are_bounded_and_training_is_repeatable(spark):
    rows, labels = corpus()
    df, marks = cases.frame(spark, rows), spark.createDataFrame(labels, LABELS)
    sample = tx.training_sample(df.select("doc_id", df.text.cast("binary").alias("text")), marks, 10, 20)
    assert sorted(r.toxic for r in sample.collect()) == [0] * 20 + [1] * 10
    a, b = (tx.train(cases.frame(spark, rows, parts), marks, 60, 150) for parts in (2, 5))
    assert a.ordinary == b.ordinary and a.toxic == b.toxic and np.allclose(a.weights, b.weights)


def test_dropping_keeps_columns(spark):
    rows, labels = corpus()
    df = cases.frame(spark, rows)
    kept = tx.drop_toxic(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    ids = {r.doc_id: r.toxicity for r in kept.collect()}
    assert all(v == f"own {i}" for i, v in ids.items())
    assert sum(i % 4 == 0 for i in ids) <= 10 and sum(i % 4 != 0 for i in ids) >= 295


def hits_of(spark, rows, labels):
    """Toxic and other held-out rows that are predicted toxic, and how many there are of each."""
    model = tx.train(cases.frame(spark, rows), tx.learn_labels(spark.createDataFrame(labels, LABELS)))
    scores = {r.doc_id: r.toxicity >= 0.5 for r in tx.scored(cases.frame(spark, rows), model).collect()}
    held = [(t, scores[i]) for i, t, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    return [[s for t, s in held if t == label] for label in (1, 0)]


def test_text_without_blanks(spark):
    rng = random.Random(4)
    letters = [chr(0x4E00 + 7 * i) for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(80, 200)))
        if i % 4 == 0:
            for _ in range(5):
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice(["鬼魔怪", "蛇蝎"]) + text[at:]
        rows.append((i, text, "zh", "s", 0))
        labels.append((i, int(i % 4 == 0), 1))
    toxic, others = hits_of(spark, rows, labels)
    assert sum(toxic) >= 0.8 * len(toxic) and sum(others) <= 0.1 * len(others)


def test_phrases_of_ordinary_words(spark):
    rng = random.Random(5)
    syllables = ["ta", "re", "mo", "li", "sun", "ker", "po", "vi", "dan", "esh"]
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(40, 90))]
        # Each word stands before another one, so they meet only where they are put together.
        for word in ["grumblor ta", "wuzzlebob ta"] * 3 + ["grumblor wuzzlebob ta"] * (4 * (i % 4 == 0)):
            words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(i % 4 == 0), 1))
    df, marks = cases.frame(spark, rows), spark.createDataFrame(labels, LABELS)
    model = tx.train(df, marks)
    assert b" grumblor wuzzlebob " in model.toxic.rpartition(b"\n")[2] and b"grumblor wuzzlebob" in model.phrases
    toxic, others = hits_of(spark, rows, labels)
    assert sum(toxic) >= 0.8 * len(toxic) and sum(others) <= 0.1 * len(others), (sum(toxic), len(toxic), sum(others), len(others))


def test_case_and_marks_of_all_scripts():
    read = [[w for part, _ in tx.windows(t.encode()) for w in part] for t in ("ÄRGER，Я", "ärger я")]
    assert read[0] == read[1] == ["ärger".encode(), "я".encode()]


def test_toxic_dictionary_is_trained_on_toxic_text(model):
    trained, _, added = model.toxic.rpartition(b"\n")
    assert b"grumblor" in trained and b"grumblor" in added and b"grumblor" not in model.ordinary
