import hashlib
import random

import numpy as np

from cadenza.llm import multiset_hash as mh
from tests.llm import cases


def test_order_of_pieces_does_not_matter():
    a, b, c = ([f"{t} words of a paragraph" for t in "abc"])
    assert np.array_equal(mh.fingerprint("\n".join([a, b, c]).encode()), mh.fingerprint("\n".join([c, a, b]).encode()))
    assert not np.array_equal(mh.fingerprint("\n".join([a, b]).encode()), mh.fingerprint("\n".join([a, b, b]).encode()))


def test_insertion_and_deletion():
    rng = random.Random(1)
    old = [cases.sentence(rng).encode() for _ in range(20)]
    lanes = mh.fingerprint(b"\n".join(old))
    moved = mh.deleted(lanes, mh.pieces(old[7]))
    moved = mh.inserted(moved, mh.pieces(b"a new paragraph"))
    assert np.array_equal(moved, mh.fingerprint(b"\n".join([*old[:7], b"a new paragraph", *old[8:]])))


def test_pieces_restore_paragraphs():
    rng = random.Random(2)
    for _ in range(50):
        text = " ".join(rng.choice(["a", "", "bb", "ccc"]) for _ in range(rng.randint(0, 60))).encode()
        assert b" ".join(mh.pieces(text)) == text


def test_likeness_follows_what_is_shared():
    rng = random.Random(3)
    text = " ".join(str(rng.random()) for _ in range(4000)).encode()
    half = text[: len(text) // 2] + " ".join(str(rng.random()) for _ in range(2000)).encode()
    other = " ".join(str(rng.random()) for _ in range(4000)).encode()
    own, near, far = map(mh.fingerprint, (text, half, other))
    assert mh.likeness(own, own) == 1.0
    assert 0.3 < mh.likeness(own, near) < 0.7
    assert mh.likeness(own, far) < 0.25
    assert mh.likeness(mh.fingerprint(b""), own) == 0.0


def test_very_many_equal_pieces():
    line, blank, other = b"the same line", b"x", "\n".join(f"other text {i}" for i in range(500)).encode()
    for n in (40_000, 65_536, 100_000):
        own = mh.fingerprint(b"\n".join([line] * n))
        near = mh.fingerprint(b"\n".join([*[line] * (3 * n // 4), other]))
        assert own.any() and mh.likeness(own, near) > 0.99
        assert mh.likeness(own, mh.fingerprint(other)) < 0.25
    for n in (32_768, 65_536):
        spaced = mh.fingerprint(blank + b" " * n)
        assert not np.array_equal(spaced, mh.fingerprint(blank))
        assert not np.array_equal(spaced, mh.fingerprint(blank + b" " * (2 * n)))
        assert mh.likeness(spaced, mh.fingerprint(blank + b" " * (2 * n))) > 0.99


def plain(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc_id, text, *_) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        own, new, nxt = (mh.fingerprint(t.encode()) for t in (text, edited, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mh.hex_of(own), mh.hex_of(new),
                    mh.likeness(own, new), mh.likeness(own, nxt)))
    return sorted(out, key=repr)


def test_awkward_documents(spark):
    rows = cases.documents()
    for parts in ("1", "4", "50"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = mh.fingerprinted(cases.frame(spark, rows)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert sorted(map(tuple, found), key=repr) == plain(rows)


def test_small_tables(spark):
    one = [(5, "alone in the table", "en", "s", 0)]
    assert [tuple(r) for r in mh.fingerprinted(cases.frame(spark, one)).collect()] == plain(one)
    assert mh.fingerprinted(cases.frame(spark, [])).count() == 0
