import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cadenza.llm import alignment
from cadenza.llm.alignment import PerfectHash
from tests.llm import cases

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Groups, links and counts by the definition, from the libraries' own calls over whole texts."""
    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = alignment.byte_letters()

    def a_bytes(i):
        return bytes(byte_of[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    def groups_of(text):
        if not text:
            return []
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        spelt = [a_bytes(i) for i in a], [b_bytes(i) for i in b]
        if any(b"".join(s) != f" {text}".encode() for s in spelt):
            return []
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelt]
        groups, at = [], [0, 0]
        for common in sorted({*ends[0]} & {*ends[1]}):
            to = [ends[0].index(common) + 1, ends[1].index(common) + 1]
            groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
            at = to
        return groups

    def run(rows):
        docs = [(d, groups_of(text)) for d, text in rows]
        counts = Counter()
        for _, groups in docs:
            counts.update({(x, y) for mine, other in groups for x in mine for y in other})
        best = Counter()
        for (x, _), n in counts.items():
            best[x] = max(best[x], n)
        out = []
        for d, groups in docs:
            links = Counter()
            for mine, other in groups:
                for x, n in Counter(mine).items():
                    for y, m in Counter(other).items():
                        links[x, y] += n * m
            text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
            out.append((
                d, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()),
                sum(n for (x, y), n in links.items() if counts[x, y] == best[x]), sum(n * counts[k] for k, n in links.items()),
                sha256(text.encode()).hexdigest() if groups else "",
            ))
        return sorted(out, key=repr), counts

    return run


def odd_texts():
    rng = random.Random(4)
    return [
        " ", "  ", "\n", " \t\n ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "two  blanks   three", "ends with line\n", "\nbegins with line",
        "a ▁ b", "▁", "under ▁score between plain words", "<|endoftext|> and <s> </s> <unk> <0x41>", "it's we'll  'tis '", "x\x00y z\x00",
        "中文 文字 没有空格的很长的一段文字", "ไทย ไม่มี ช่องว่าง", "😀 👩‍👩‍👧 é ﻿ x", "a b c　d   e", "1234567 89 1 000", "tab\tand\x0bother\x0cblanks\x85next line",
        "aaaa" * 900, "xyxxyyx" * 700, "=" * 5000, "  " * 3000, "word " * 3000, "".join(rng.choice("abcdefgh0123 ") for _ in range(6000)),
        "".join(chr(rng.randrange(0x20, 0x2FFF)) for _ in range(4000)),
    ]


def test_as_the_libraries_over_awkward_texts(spark, plain, monkeypatch):
    rows = cases.documents() + [(2000 + i, t, "en", "s", 0) for i, t in enumerate(odd_texts())]
    found = alignment.aligned(cases.frame(spark, rows, 5), A, B)
    assert found.columns == alignment.RESULT.names
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == plain([(r[0], r[1]) for r in rows])[0]


def test_small_bundles_stretches_and_sums_in_levels(spark, plain, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(cases.sentence(rng, 12) for _ in range(4)), "en", "s", 0) for i in range(120)]
    rows += [(2000 + i, t, "en", "s", 0) for i, t in enumerate(odd_texts())]
    for name, value in {"BUNDLES_PER_SUM": 2, "FAN_IN": 2}.items():
        monkeypatch.setattr(alignment, name, value)
    docs = cases.frame(spark, rows, 12)
    got = sorted((tuple(r) for r in alignment.aligned(docs, A, B).collect()), key=repr)
    want, counts = plain([(r[0], r[1]) for r in rows])
    assert got == want
    assert {(r.a, r.b): r.n_docs for r in alignment.pair_counts(docs, A, B).collect()} == dict(counts)


def test_stretches_meet_again():
    both = alignment.Tokenizers(A, B)
    for text in odd_texts():
        whole = both.parts(text, ())
        assert [p for s in alignment.stretches(text, 50) for p in both.parts(s, ())] == whole
        assert "".join(map(alignment.whole_part, whole)) == f" {text}"


def test_both_libraries_of_a_side_agree():
    both = alignment.Tokenizers(A, B)
    end = ord(alignment.FAST_END)
    names = [f"{x}{chr(c)}{y}" for c in range(33, end) for x in ("", "a", "7", "'") for y in ("", "s", "9", "!") if not chr(c).isspace()]
    for i, ids in both._side_a(names):
        assert ids.tolist() == both.a.encode(f" {names[i]}", add_special_tokens=False).ids, names[i]


def test_wide_groups_are_counted_by_different_ids(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, 60), rng.integers(0, 3, 40)
    lengths_a, lengths_b = np.full(4, 2), np.full(3, 3)

    def links(limit):
        monkeypatch.setattr(alignment, "WIDE_GROUP", limit)
        part, key, times = alignment.Aligned(a, np.array([60]), b, np.array([40]), lengths_a, lengths_b).pairs()
        total = Counter()
        for p, k, n in zip(part.tolist(), key.tolist(), times.tolist()):
            total[p, k] += n
        return total

    assert links(0) == links(1 << 20)


def test_empty(spark):
    assert alignment.aligned(cases.frame(spark, []), A, B).collect() == []
    nothing = [(1, None, None, None, None), (2, "", "en", "s", 0)]
    found = alignment.aligned(cases.frame(spark, nothing), A, B).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_hash_is_minimal_perfect_and_checked(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 48, n))
    made = PerfectHash.of(keys)
    found = made.number(keys)
    assert sorted(found.tolist()) == list(range(len(keys)))
    again = PerfectHash(made.sizes, made.packed())
    assert (again.number(keys) == found).all()
    stored = np.empty(len(keys), dtype=np.int64)
    stored[found] = keys
    assert (again.checked(keys, stored) == found).all()
    other = np.setdiff1d(rng.integers(0, 1 << 48, 50), keys)
    if n:
        with pytest.raises(ValueError):
            again.checked(other, stored)
    # A few bits for each key.
    assert n < 1000 or len(made.packed()) * 8 < 4 * n
