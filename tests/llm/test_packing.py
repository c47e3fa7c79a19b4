import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm import packing as pk
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_words_are_encoded_as_by_the_library(tokenizer):
    encoder, rng = pk.WordEncoder(PATH), random.Random(2)
    parts = ["a", "B", "É", "é", "É", "J̌", " ", "\n", "\t", "\x0b", "\x85", " ", "\x00", "<|endoftext|>", "'s", "12",
             "中", "Σ", "ΑΣ", "!!", " ", "﻿", "İ", "\x1c", "ſ", "ﬁ", ".", ",", "ß", "ǅ", "word", "Word.", "x,"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encoder.encode(text.encode()) == ids(tokenizer, text), text


def test_special_tokens_are_tokens(tokenizer):
    encoder = pk.WordEncoder(PATH)
    for text in ("hello <|endoftext|> world", "hello<|endoftext|>World.<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext| >", "a <|endoftext|><|endoftext|> é"):
        assert encoder.encode(text.encode()) == ids(tokenizer, text), text
    assert np.frombuffer(encoder.encode(b"hello <|endoftext|> world"), "<u4").tolist() == [3306, 49407, 1002]


def test_forgotten_words_and_long_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(pk, "KEPT_WORDS", 10)
    monkeypatch.setattr(pk, "KEPT_BYTES", 6)
    encoder, rng = pk.WordEncoder(PATH), random.Random(3)
    for _ in range(30):
        text = cases.sentence(rng, 60) + " longerthansix, Longerthansix."
        assert encoder.encode(text.encode()) == ids(tokenizer, text)
    long = cases.sentence(rng, 300_000)
    assert encoder.encode(long.encode()) == ids(tokenizer, long)


def check_plan(counts, most):
    plan, n = pk.packing_plan(counts, most)
    used, fill = Counter(), Counter()
    ranks = {}
    for length, first, k, sequence, offset in plan:
        ranks.setdefault(length, []).extend(range(first, first + k))
        for i in range(k):
            used[length] += 1
            fill[sequence + i] += length
    assert used == Counter({x: c for x, c in counts.items() if c})
    assert all(sorted(r) == list(range(counts[x])) for x, r in ranks.items())
    assert all(f <= most for f in fill.values()) and len(fill) == n
    # Offsets leave no gap and no overlap.
    spans = {}
    for length, _, k, sequence, offset in plan:
        for i in range(k):
            spans.setdefault(sequence + i, []).append((offset, length))
    for found in spans.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
    return n


def fewest(lengths, most):
    """The fewest sequences, by trying all ways."""
    best = len(lengths)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        head, tail = rest[0], rest[1:]
        for i in {room: i for i, room in enumerate(rooms) if room >= head}.values():
            place(tail, rooms[:i] + [rooms[i] - head] + rooms[i + 1 :])
        place(tail, [*rooms, most - head])

    place(sorted(lengths, reverse=True), [])
    return best


def test_fixed_sets_are_part_of_a_best_packing():
    rng = random.Random(1)
    for _ in range(400):
        most = rng.randint(5, 30)
        lengths = [rng.randint(1, most) for _ in range(rng.randint(1, 9))]
        left = pk.Instance(Counter(lengths), most)
        pk.reduce(left)
        rest = [x for x, n in left.left.items() for _ in range(n)]
        assert left.sequences + (fewest(rest, most) if rest else 0) == fewest(lengths, most), (lengths, most)


def test_plans_are_sound_and_near_the_bound():
    rng = random.Random(2)
    for most, n in ((10, 50), (64, 500), (4096, 3000)):
        counts = Counter(min(most, max(1, int(rng.lognormvariate(4, 1.2)))) for _ in range(n))
        used = check_plan(counts, most)
        bound = -(-sum(x * c for x, c in counts.items()) // most)
        assert used <= bound * 1.02 + 1
    assert check_plan({7: 10**6, 4096: 5, 4089: 10**6}, 4096) == 10**6 + 5
    assert check_plan({}, 8) == 0
    assert len(pk.packing_plan({x: 10**9 + x for x in range(1, 4097)}, 4096)[0]) < 100_000


def test_awkward_documents(spark, tokenizer):
    rows = cases.documents()
    found = pk.pack_documents(cases.frame(spark, rows), PATH, most=64).toPandas()
    expected = []
    for doc_id, text, *_ in rows:
        all_ids = ids(tokenizer, text or "") + np.array([1], dtype="<u4").tobytes()
        for piece, at in enumerate(range(0, len(all_ids), 256)):
            part = all_ids[at : at + 256]
            expected.append((doc_id, piece, at // 4, len(part) // 4, crc32(part)))
    got = [(None if np.isnan(d) else int(d), *map(int, r)) for d, *r in found[["doc_id", "piece", "start", "length", "ids_crc32"]].values]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    ordered = found.sort_values(["sequence_id", "offset"])
    before = ordered.groupby("sequence_id").length.cumsum() - ordered.length
    assert (before == ordered.offset).all() and ordered.groupby("sequence_id").length.sum().max() <= 64
    assert pk.pack_documents(cases.frame(spark, []), PATH).count() == 0


def test_ranks_in_blocks(spark):
    rows = [(i, 0, 0, rng_length, i) for i, rng_length in enumerate([5] * 500 + [6] * 3)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = pk.ranked(pieces, 40).select("length", "rank").collect()
    for length, n in ((5, 500), (6, 3)):
        assert sorted(r["rank"] for r in found if r.length == length) == list(range(n))
