"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that its encoding can end with. That
token is the only one ending there which may follow the last token of the prefix before it; two
tokens may stand side by side if merging their bytes would never have joined across the border.
The table of last tokens is all that is kept: reading it backwards gives the encoding of any
prefix, appended bytes only add entries, and an edit leaves the entries before it as they are.

This holds for vocabularies made by merging, whose ranks follow the order in which tokens were made,
so that a token's halves have lower ranks than the token.

Texts are first cut by the pattern; a piece that is a token itself is encoded as that token. Each
Python worker keeps the encodings of short pieces.

Defined results:
- A missing or empty text has no tokens; the digest of its ids is that of the empty string. A text of
  any length is encoded match by match; its ids are held at once.
- Rows that share a doc_id are encoded one by one; an empty table gives an empty result; other
  columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, kept_by_worker, rows_in
from cadenza.session import send_with_tasks

KEPT_PIECES = 800_000
KEPT_BYTES = 64
KEPT_PAIRS = 1_000_000
AT_ONCE = 1 << 18
LONG = 1 << 22


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file with a base64 token and a rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens with the two halves each was last merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.above = max(ranks.values(), default=0) + 2
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            halves = self._last_merge(token, rank)
            # A token that merging its own bytes never yields occurs as a whole piece only.
            if len(token) == 1 or halves:
                self.halves[rank] = halves
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            least = min(joined)
            if least >= rank:
                return None
            i = joined.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens can be neighbours in an encoding."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._never_joined(left, right)
        return known

    def _never_joined(self, left: int, right: int) -> bool:
        # Merges are undone at the border, latest first. The two parts now at the border were both
        # there until `until`, the rank of the earlier of the merges that took one of them in.
        until = self.above
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < until:
                return False
            # Of equal tokens, the one on the left was merged first.
            undo_left = left > right
            halves = self.halves[left if undo_left else right]
            if halves is None:
                # The later one is a single byte, so its rank tells nothing of when it came to be.
                undo_left = not undo_left
                halves = self.halves[left if undo_left else right]
                if halves is None:
                    return True
            if undo_left:
                until, left = left, halves[1]
            else:
                # At the same rank, a merge across the border would come before one to its right.
                until, right = right + 1, halves[0]


class PrefixTable:
    """The last token of every prefix of a piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = bytearray()
        self.last = array("l")
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; nothing before them changes."""
        start = len(self.piece)
        self.piece += more
        since = max(0, start - self.vocabulary.longest)
        tokens, may_follow, last = self.vocabulary.tokens, self.vocabulary.may_follow, self.last
        # Matches come by the place they end at; the first that fits settles it.
        for end, rank in self.vocabulary.automaton.iter(self.piece[since:].decode("latin-1")):
            at = since + end
            if at == len(last):
                before = at - len(tokens[rank])
                if before < 0 or may_follow(last[before], rank):
                    last.append(rank)
        if len(last) != len(self.piece):
            raise ValueError("a byte is not in the vocabulary")

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Exchange bytes; only entries near the edit are made anew.

        An entry depends on as many bytes and entries before it as the longest token has. Once that
        many in a row behind the edit are as they were, all that follow are.
        """
        rest, known = bytes(self.piece[end:]), self.last[end:]
        del self.piece[start:], self.last[start:]
        self.append(by)
        reach, done, same = self.vocabulary.longest, 0, 0
        while done < len(rest) and same < reach:
            made = len(self.last)
            self.append(rest[done : done + reach])
            for new, old in zip(self.last[made:], known[done : done + reach]):
                same = same + 1 if new == old else 0
            done += reach
        self.piece += rest[done:]
        self.last += known[done:]

    def encode(self, length: int | None = None) -> list[int]:
        """The encoding of the first `length` bytes, of all by default."""
        at = len(self.piece) if length is None else length
        found = []
        while at > 0:
            rank = self.last[at - 1]
            found.append(rank)
            at -= len(self.vocabulary.tokens[rank])
        return found[::-1]


def _ranges(characters: set[str]) -> str:
    """The inside of a character class for a set of characters."""
    codes = sorted(map(ord, characters))
    starts = [c for c in codes if chr(c - 1) not in characters]
    ends = [c for c in codes if chr(c + 1) not in characters]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


@lru_cache(maxsize=4)
def splitting(pattern: str) -> tuple[str, str, str]:
    """The pattern, the same with letters and digits as the library sees them, the characters at odds.

    The two regular-expression engines follow different editions of Unicode, so a few letters that
    one of them knows are none to the other. Texts without such characters need only the first.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    exact, odd = pattern, set()
    for kind in (r"\p{L}", r"\p{N}"):
        theirs = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={})
        known = set(bytes(theirs.encode_ordinary(every)).decode())
        ours = set(regex.findall(kind, every))
        odd |= known ^ ours
        out = f"--[{_ranges(ours - known)}]" if ours - known else ""
        more = f"[{_ranges(known - ours)}]" if known - ours else ""
        exact = exact.replace(kind, f"[{more}[{kind}{out}]]")
    return pattern, "(?V1)" + exact, f"[{_ranges(odd)}]" if odd else "(?!)"


class Codec:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], splitting: tuple[str, str, str]):
        self.vocabulary = Vocabulary(ranks)
        self.usual, self.exact, self.odd = map(regex.compile, splitting)
        self.kept: dict[str, str] = {}
        self.by_name = {str(rank): token for rank, token in self.vocabulary.tokens.items()}

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self.vocabulary, piece).encode()

    def _written(self, piece: str) -> str:
        found = self.kept.get(piece)
        if found is None:
            found = ",".join(map(str, self.encode_piece(piece.encode())))
            if len(piece) <= KEPT_BYTES:
                if len(self.kept) > KEPT_PIECES:
                    self.kept.clear()
                self.kept[piece] = found
        return found

    def written(self, text: str):
        """The ids of a text in decimal, joined by commas, in parts of bounded size."""
        pattern = self.exact if not text.isascii() and self.odd.search(text) else self.usual
        found = iter(pattern.findall(text)) if len(text) < LONG else (m[0] for m in pattern.finditer(text))
        while pieces := list(islice(found, AT_ONCE)):
            ids = list(map(self.kept.get, pieces))
            if None in ids:
                ids = [known or self._written(piece) for known, piece in zip(ids, pieces)]
            yield ",".join(ids)

    def decoded(self, written: str) -> bytes:
        """The bytes of ids in decimal, joined by commas."""
        return b"".join(map(self.by_name.__getitem__, written.split(",")))

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.written(text) for i in part.split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def codec(path: str, splitting: tuple[str, str, str]) -> Codec:
    return kept_by_worker(("codec", path, splitting), lambda: Codec(read_ranks(path), splitting))


def _with_codec(docs: DataFrame, path: str, pattern: str, result, fields: str, schema: pa.Schema, id_col: str, value) -> DataFrame:
    rules = splitting(pattern)

    def run(batches):
        found = codec(path, rules)
        yield from batches_of(((doc_id, *result(found, item)) for doc_id, item in rows_in(batches)), schema, 500)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), value).mapInArrow(run, fields)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (list of int) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return _with_codec(docs, path, pattern, lambda c, t: (c.encode(t),), "doc_id long, ids array<int>", schema, id_col, text)


def decoded(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes of every list of ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")
    return _with_codec(rows, path, pattern, lambda c, i: (c.decode(i),), "doc_id long, bytes binary", schema, id_col, ids)


def _digests(found: Codec, text: str) -> tuple[int, str, str]:
    n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
    for part in found.written(text):
        ids.update(f",{part}".encode() if n else part.encode())
        back.update(found.decoded(part))
        n += part.count(",") + 1
    return n, ids.hexdigest(), back.hexdigest()


def round_trips(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and its ids decoded again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return _with_codec(docs, path, pattern, _digests, fields, schema, id_col, text)


send_with_tasks(__name__)
