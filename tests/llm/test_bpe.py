import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cadenza.llm import bpe
from tests.llm import cases

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), bpe.splitting(PATTERN))


def test_texts_are_encoded_as_by_the_library(codec, library):
    rng = random.Random(1)
    # The last few are letters to one of the two regular-expression engines only.
    parts = ["a", "the", " th", "ing", " ", "  ", "\n", "\t", "é", "́", "中文", "😀", "1", "23", "'s", "!!", "==", "\x00",
             "\x1c", "\x85", " ", "हि", "لا", "\u0558", "\u088f", "\U0003fc3b"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        found = codec.encode(text)
        assert found == library.encode_ordinary(text), text
        assert codec.decode(found) == text.encode()


def test_every_token_and_pairs_of_tokens(codec):
    ranks = codec.vocabulary.ranks
    assert all(codec.encode_piece(token) == [rank] for token, rank in ranks.items())


def merged(ranks, piece):
    """Merging by the definition: the pair of lowest rank first, leftmost of equal ones."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def first_ranks(n):
    """The beginning of a vocabulary is one itself."""
    return {token: rank for token, rank in bpe.read_ranks(PATH).items() if rank < n}


@pytest.mark.parametrize("n", [270, 400, 3000])
def test_prefix_tables_of_smaller_vocabularies(n):
    rng, ranks = random.Random(n), first_ranks(n)
    vocabulary = bpe.Vocabulary(ranks)
    for letters in (b"aeinrst ", b"the ", b"a"):
        for _ in range(150):
            piece = bytes(rng.choice(letters) for _ in range(rng.randint(1, 25)))
            table = bpe.PrefixTable(vocabulary, piece)
            for k in range(1, len(piece) + 1):
                assert table.encode(k) == merged(ranks, piece[:k]), piece[:k]


def test_appends_and_edits_give_the_table_of_the_new_bytes():
    rng = random.Random(4)
    vocabulary = bpe.Vocabulary(first_ranks(3000))
    table, held = bpe.PrefixTable(vocabulary), b""
    for _ in range(200):
        more = bytes(rng.choice(b"aeinrst ") for _ in range(rng.randint(0, 5)))
        if rng.random() < 0.5 or not held:
            table.append(more)
            held += more
        else:
            start = rng.randint(0, len(held))
            end = rng.randint(start, len(held))
            table.replace(start, end, more)
            held = held[:start] + more + held[end:]
        assert bytes(table.piece) == held
        assert list(table.last) == list(bpe.PrefixTable(vocabulary, held).last)


def test_an_edit_is_encoded_anew_near_its_place_only(codec, monkeypatch):
    vocabulary, rng, handed = codec.vocabulary, random.Random(11), []
    append = bpe.PrefixTable.append
    held = "".join(rng.choice("abcdefgh etinrs") for _ in range(50_000)).encode()
    table = bpe.PrefixTable(vocabulary, held)
    monkeypatch.setattr(bpe.PrefixTable, "append", lambda self, more: (handed.append(len(more)), append(self, more)))
    for start, end, more in [(25_000, 25_003, b"xyz"), (100, 100, b"insertion"), (49_000, 49_500, b""), (0, 1, b""), (7, 9, b"q" * 700)]:
        table.replace(start, end, more)
        held = held[:start] + more + held[end:]
        assert sum(handed) <= len(more) + 20 * vocabulary.longest
        handed.clear()
        assert bytes(table.piece) == held
    assert list(table.last) == list(bpe.PrefixTable(vocabulary, held).last)
    # A run of one letter, where an edit shifts all that follows, is encoded anew as far as it goes.
    run = bpe.PrefixTable(vocabulary, b"a" * 3000 + b" b")
    run.replace(0, 1, b"")
    assert list(run.last) == list(bpe.PrefixTable(vocabulary, b"a" * 2999 + b" b").last)


def test_a_byte_outside_of_the_vocabulary_is_an_error():
    with pytest.raises(ValueError):
        bpe.PrefixTable(bpe.Vocabulary({b"a": 0}), b"ab")


def test_caches_that_overflow_and_long_texts(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    monkeypatch.setattr(bpe, "LONG", 100)
    own = bpe.Codec(bpe.read_ranks(PATH), bpe.splitting(PATTERN))
    text = cases.sentence(random.Random(5), 200) + " unusualunusual" * 3
    assert own.encode(text) == library.encode_ordinary(text)
    assert codec.encode("a" * 100_000 + " " * 100_000) != []


def test_awkward_documents(spark, library):
    rows = cases.documents()
    df = cases.frame(spark, rows)
    expected = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        written = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc_id, len(ids), written, hashlib.sha256((text or "").encode()).hexdigest()))
    found = [tuple(r) for r in bpe.round_trips(df, PATH, PATTERN).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    back = bpe.decoded(bpe.encoded(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((bytes(r.bytes) for r in back)) == sorted((r[1] or "").encode() for r in rows)
    assert bpe.round_trips(cases.frame(spark, []), PATH, PATTERN).count() == 0
