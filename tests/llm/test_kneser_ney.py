import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from cadenza.llm import kneser_ney as kn
from tests.llm import cases


class Plain:
    """The model by its definition, for one language."""

    def __init__(self, texts, discounts, n_chars, order=kn.ORDER):
        self.order, self.discounts, self.even = order, discounts, 1 / (n_chars + 1)
        top = Counter()
        for text in texts:
            padded = kn.PAD * (order - 1) + text
            top.update(padded[i : i + order] for i in range(len(text)))
        self.counts = {order: top}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.contexts = {n: defaultdict(list) for n in self.counts}
        for n, counts in self.counts.items():
            for g, c in counts.items():
                self.contexts[n][g[:-1]].append(c)

    def p(self, gram):
        if not gram:
            return self.even
        n = len(gram)
        taken = lambda c: self.discounts[n][min(c, 3) - 1]
        after = self.contexts[n].get(gram[:-1])
        if not after:
            return self.p(gram[1:])
        c = self.counts[n].get(gram, 0)
        own = max(c - taken(c), 0) / sum(after) if c else 0
        return own + sum(map(taken, after)) / sum(after) * self.p(gram[1:])

    def log_prob(self, text):
        padded = kn.PAD * (self.order - 1) + text
        return sum(math.log(self.p(padded[i : i + self.order])) for i in range(len(text)))


def plain_discounts(model):
    """Discounts by order from the counts of a language."""
    found = {}
    for n in range(1, kn.ORDER + 1):
        t = Counter(model.counts[n].values())
        if not t[1] or not t[2]:
            found[n] = (0.5, 0.5, 0.5)
            continue
        y = t[1] / (t[1] + 2 * t[2])
        third = 3 - 4 * y * t[4] / t[3] if t[3] else 2 - 3 * y * t[3] / t[2]
        raw = (1 - 2 * y * t[2] / t[1], 2 - 3 * y * t[3] / t[2], third)
        found[n] = tuple(min(max(d, 0.1), float(i)) for i, d in enumerate(raw, 1))
    return found


def plain(rows, trusted):
    texts = defaultdict(list)
    for doc_id, text, lang, *_ in rows:
        if doc_id in trusted:
            texts[lang or ""].append(text or "")
    chars = {c for found in texts.values() for t in found for c in t}
    models = {lang: Plain(found, None, len(chars)) for lang, found in texts.items()}
    out = []
    for doc_id, text, lang, *_ in rows:
        model = models.get(lang or "") or Plain([], None, len(chars))
        model.discounts = plain_discounts(model)
        out.append((doc_id, lang or "", len(text or ""), round(model.log_prob(text or ""), 2)))
    return sorted(out, key=repr)


def found(spark, rows, trusted, partitions=3):
    marks = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    scored = kn.perplexities(cases.frame(spark, rows, partitions), marks)
    return sorted(((r.doc_id, r.lang, r.n_chars, round(r.log_prob, 2)) for r in scored.collect()), key=repr)


def close(a, b):
    assert len(a) == len(b)
    key = lambda r: (repr(r[0]), r[1], r[2])
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        assert x[:3] == y[:3] and abs(x[3] - y[3]) <= 0.02 + 1e-5 * abs(y[3]), (x, y)


def test_awkward_documents_by_the_definition(spark, monkeypatch):
    rows = [r for r in cases.documents() if len(r[1] or "") < 5000]
    trusted = [*range(0, 60, 2), 201, 306, 307, None, 999]
    expected = plain(rows, {*trusted} - {None})
    close(found(spark, rows, trusted), expected)
    # Small bundles and stretches give the same.
    monkeypatch.setattr(kn, "BUNDLE_BYTES", 300)
    monkeypatch.setattr(kn, "AT_ONCE", 50)
    monkeypatch.setattr(kn, "PIECE_CHARS", 40)
    close(found(spark, rows, trusted, 2), expected)


def test_probabilities_after_a_context_sum_to_one(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(40)) for _ in range(10)]
    model = Plain(texts, None, 3)
    model.discounts = plain_discounts(model)
    for context in ("", "a", "ab", "abc", "zz"):
        assert abs(sum(model.p((context + c)[-kn.ORDER :]) for c in "abc") + model.p((context + "?")[-kn.ORDER :]) - 1) < 1e-9


def test_long_and_empty_texts(spark):
    rows = [(1, "abcd " * 200_000, "en", "s", 0), (2, "", "en", "s", 0), (3, None, None, "s", 0), (4, "ab", "en", "s", 0)]
    scores = {r[0]: r for r in found(spark, rows, [1])}
    assert scores[1][2] == 1_000_000 and scores[2][3] == 0 and scores[3][3] == 0 and scores[4][3] < 0
    assert found(spark, [], [1]) == []
    assert len(found(spark, rows, [])) == 4


def test_more_characters_than_a_block_tells_apart(spark, monkeypatch):
    rows = [(i, "".join(map(chr, range(0x4E00 + 40 * i, 0x4E00 + 40 * i + 60))) + "abcab", "en", "s", 0) for i in range(30)]
    trusted = [*range(0, 30, 3)]
    expected = plain(rows, {*trusted})
    monkeypatch.setattr(kn, "ALPHABET", 100)
    blob = zstandard.ZstdCompressor().compress("".join(r[1] for r in rows).encode())
    blocks = [*kn._blocks(["en"] * 30, [len(r[1].encode()) for r in rows], [0] * 30, blob)]
    assert len(blocks) > 10 and sorted(i for _, places, _ in blocks for i in places) == list(range(30))
    close(found(spark, rows, trusted), expected)


def test_a_text_of_many_pieces_is_scored_whole(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdé ") for _ in range(3 * kn.PIECE_CHARS + 100))
    rows = [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, "abc", "en", "s", 0), (3, text[: kn.PIECE_CHARS], "en", "s", 0)]
    close(found(spark, rows, [1, 3]), plain(rows, {1, 3}))


def test_memory_of_a_block_stays_small():
    import tracemalloc

    text = "some words of a text " * 200_000
    tracemalloc.start()
    block = kn.Block([text])
    block.counted(np.array([True]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Two bytes a character beside what a stretch takes.
    assert most < 2 * len(text) + 90 * kn.AT_ONCE


def test_verdicts(spark):
    rng = random.Random(3)
    good = [(i, cases.sentence(rng, rng.randint(40, 80)), "en", "s", 0) for i in range(150)]
    noise = [(1000 + i, "".join(chr(rng.randint(33, 126)) for _ in range(300)), "en", "s", 0) for i in range(10)]
    rest = [(2000, "", "en", "s", 0), (2001, None, "en", "s", 0), (2002, "no model of this language", "xx", "s", 0)]
    df = cases.frame(spark, good + noise + rest)
    trusted = spark.createDataFrame([(i,) for i in range(0, 150, 2)] * 2, "doc_id long")
    judged = {r.doc_id: r for r in kn.judge(df, trusted).collect()}
    assert len(judged) == 163
    assert sum(judged[i].kept for i in range(150)) >= 149
    assert not any(judged[1000 + i].kept for i in range(10))
    assert (judged[2000].kept, judged[2001].kept, judged[2002].kept) == (False, False, True)
    kept = kn.keep_fluent(df, trusted)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in judged.items() if r.kept}


def test_all_is_kept_without_trusted_documents(spark):
    rows = cases.documents()
    none = spark.createDataFrame([], "doc_id long")
    assert {r.kept for r in kn.judge(cases.frame(spark, [r for r in rows if r[1]]), none).collect()} == {True}
    assert kn.judge(cases.frame(spark, []), none).count() == 0


@pytest.mark.parametrize("lang", ["", "en"])
def test_bundles_hold_every_document(spark, lang):
    rows = [(i, f"text {i}", lang, "s", 0) for i in range(500)]
    bundles = kn.bundled(cases.frame(spark, rows), "doc_id", "text", "lang").collect()
    assert sorted(i for b in bundles for i in b.doc_ids) == list(range(500))
