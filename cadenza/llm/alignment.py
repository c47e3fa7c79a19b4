"""Alignment of two tokenizations, with corpus-wide counts of linked token ids.

A text is cut at single blanks between other signs, where neither tokenizer has a token across. A part
is encoded once per worker and bundle; its tokens of both sides are grouped by the byte offsets at
which both end. Documents are kept as bundles: numbers of parts, and the ids of each different part.

How many documents hold a linked pair of ids is counted by perfect hashing. The distinct pairs are
dealt to shards, each with a minimal perfect hash function of its own. Every bundle's counts become
dense vectors, indexed by the hash, that are summed up a tree. The keys are kept in hash order, and
each look-up is checked against them. Then the bundles ask for their pairs, and a second pass aligns
the documents again and adds up the counts. No task holds more than a shard or a bundle; what goes to
all tasks is one number for each id of the first tokenizer.

Defined results:
- A missing or empty text, and one whose tokens of either side do not spell a blank and the text, has
  no tokens: zeros and an empty string.
- Every row is a document, also where rows share a doc_id or have none. An empty table gives an empty
  result. Other columns are ignored.
- A text of any length is encoded in stretches; a bundle is as large as its longest text. A part
  without a blank is one whole, and links of a group of it are counted by different ids.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import kept_by_worker, row_of, utf8
from cadenza.session import cut, new_path, send_with_tasks

BUNDLE_CHARS = 2 << 20
STRETCH = 1 << 20
KEPT_PARTS = 100_000
KEPT_CHARS = 32
# Parts up to this length, of characters that all versions of Unicode class alike, go to the faster
# of two libraries with the same vocabulary.
FAST_CHARS = 200
FAST_END = "\u0250"
# Groups with more links than this are counted by different ids.
WIDE_GROUP = 4096
LEAST_SHARDS = 64
KEYS_PER_SHARD = 1 << 16
SLOTS = 1 << 20
BUNDLES_PER_SUM = 1024
FAN_IN = 64
# Bits of a level of the hash function for each key that is left.
ROOM = 1.5

# A single blank between other signs: neither tokenizer joins what stands on its two sides.
BETWEEN = re.compile(r"(?<=\S)(?= \S)")

BUNDLE = pa.schema(
    [("bundle", pa.int64()), ("n_keys", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("parts", pa.binary()),
     ("a_ids", pa.binary()), ("a_sizes", pa.binary()), ("b_ids", pa.binary()), ("b_sizes", pa.binary()),
     ("keys", pa.binary()), ("holders", pa.binary())]
)
BUNDLE_FIELDS = (
    "bundle long, n_keys long, doc_ids array<long>, sizes binary, parts binary, a_ids binary, a_sizes binary, "
    "b_ids binary, b_sizes binary, keys binary, holders binary"
)
RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
     ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
)
RESULT_FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as themselves, the
    others by the next code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the ids of parts met before.

    A part is named by its text without the blank before it. One with white space at an end is only a
    part within its text; its name begins with a blank.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        names = self.a.get_vocab(with_added_tokens=True)
        plain = self.a.get_vocab(with_added_tokens=False)
        ranks = {}
        self.a_bytes = [b""] * (1 + max(names.values()))
        for name, i in names.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, name)) if set(name) <= letters.keys() else name.encode()
            if name in plain and i not in self.a.get_added_tokens_decoder():
                ranks[self.a_bytes[i]] = i
        # The same vocabulary in a faster library, for text that both cut in the same way.
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i in range(self.b.get_piece_size())
            for p in [self.b.id_to_piece(i)]
        ]
        self.a_lengths = np.array([len(b) for b in self.a_bytes], dtype=np.int64)
        self.b_lengths = np.array([len(b) for b in self.b_bytes], dtype=np.int64)
        # Two generations: parts not met again while one fills up are forgotten.
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    @staticmethod
    def parts(text: str, known) -> list[str]:
        """The parts of a text by name; known holds names of parts met before."""
        parts = text.split(" ")
        for part in {*parts}.difference(known):
            if not part or len(part.strip()) < len(part):
                found = (p[1:] for p in BETWEEN.split(f" {text}"))
                return [p if len(p.strip()) == len(p) else f" {p}" for p in found]
        return parts

    def _side_a(self, names: list[str]) -> list[tuple[int, np.ndarray]]:
        """Place and ids of each part on the first side."""
        quick = [i for i, p in enumerate(names) if p[0] != " " and len(p) <= FAST_CHARS and (p.isascii() or max(p) < FAST_END)]
        found = []
        for at in range(0, len(quick), 5000):
            some = quick[at : at + 5000]
            parts = [f" {names[i]}" for i in some]
            ids = np.array(self.fast.encode_ordinary("".join(parts)), dtype="<i4")
            ends = np.cumsum([len(p.encode()) for p in parts])
            # A token ends wherever a part does.
            to = np.searchsorted(np.cumsum(self.a_lengths[ids]), ends) + 1
            found += zip(some, np.split(ids, to[:-1]))
        rest = sorted({*range(len(names))}.difference(quick))
        for i, made in zip(rest, self.a.encode_batch_fast([whole_part(names[i]) for i in rest], add_special_tokens=False)):
            found.append((i, np.array(made.ids, dtype="<i4")))
        return found

    def encoded(self, names: list[str]) -> list[tuple]:
        """For each part the ids of both sides, as bytes, and whether they spell it."""
        new = [p for p in names if p not in self.young and p not in self.old]
        a = [b""] * len(new)
        for i, ids in self._side_a(new):
            a[i] = ids.tobytes()
        b = self.b.encode([p.removeprefix(" ") if p[0] == " " else p for p in new], num_threads=1)
        sizes = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
        flat = np.fromiter(chain.from_iterable(b), dtype="<i4", count=int(sizes.sum()))
        raw, to = flat.tobytes(), 4 * np.cumsum(sizes)
        b = [raw[i:j] for i, j in zip([0, *to.tolist()], to.tolist())]
        whole = [whole_part(p).encode() for p in new]
        right = [len(w) for w in whole]
        spelt = [True] * len(new)
        for side, table, lengths in ((a, self.a_bytes, self.a_lengths), (b, self.b_bytes, self.b_lengths)):
            ids = np.frombuffer(b"".join(side), "<i4")
            ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.cumsum([0, *(len(x) // 4 for x in side)])]
            if np.array_equal(np.diff(ends), right) and b"".join(map(table.__getitem__, ids.tolist())) == b"".join(whole):
                continue
            for i, x in enumerate(side):
                spelt[i] &= b"".join(table[j] for j in np.frombuffer(x, "<i4").tolist()) == whole[i]
        found = dict(zip(new, zip(a, b, spelt)))
        young, old, result = self.young, self.old, []
        for name in names:
            entry = found.get(name) or young.get(name) or old[name]
            result.append(entry)
            if len(name) <= KEPT_CHARS and name[0] != " ":
                young[name] = entry
        if len(young) > KEPT_PARTS:
            self.old, self.young = young, {}
        return result

    def spell(self, entries: list[tuple], side: int) -> bytes:
        table = self.b_bytes if side else self.a_bytes
        return b"".join(table[i] for entry in entries for i in np.frombuffer(entry[side], "<i4").tolist())


def whole_part(name: str) -> str:
    """The text of a part with the blank before it."""
    return name if name[0] == " " else f" {name}"


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in stretches that begin and end at places where parts do, without the blank between."""
    start = 0
    while len(text) - start > size:
        met = BETWEEN.search(text, start + size)
        if not met:
            break
        yield text[start : met.start()]
        start = met.start() + 1
    yield text[start:]


class Aligned:
    """Groups and links of the tokens of many parts, side by side."""

    def __init__(self, a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, a_lengths, b_lengths):
        self.a, self.b = a, b
        a_end, b_end = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
        # Both ends are ascending, and a part has the same bytes on both sides.
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        n = len(common)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.part_a = np.cumsum([0, *a_sizes.tolist()])
        self.part_b = np.cumsum([0, *b_sizes.tolist()])
        owner = np.repeat(np.arange(len(a_sizes)), a_sizes)
        first = np.cumsum(self.in_a) - self.in_a
        self.part_of_group = owner[first]
        self.links = self.in_a * self.in_b

    def by_part(self, values: np.ndarray, parts: np.ndarray | None = None) -> np.ndarray:
        """Sums over each part, of values per group unless their parts are given."""
        total = np.zeros(len(self.part_a) - 1, dtype=np.int64)
        np.add.at(total, self.part_of_group if parts is None else parts, values)
        return total

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """part, key, times: the links of every group; a key holds the ids of both sides."""
        first_b = np.cumsum(self.in_b) - self.in_b
        plain = self.links[self.group_a] <= WIDE_GROUP
        a, group = self.a[plain], self.group_a[plain]
        each = self.in_b[group]
        starts = np.cumsum(each) - each
        other = np.arange(each.sum()) - np.repeat(starts - first_b[group], each)
        parts = [np.repeat(self.part_of_group[group], each)]
        keys = [np.repeat(a.astype(np.int64) << 32, each) | self.b[other]]
        times = [np.ones(len(keys[0]), dtype=np.int64)]
        first_a = np.cumsum(self.in_a) - self.in_a
        for g in np.flatnonzero(self.links > WIDE_GROUP):
            mine, n = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            others, m = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            keys.append((mine.astype(np.int64)[:, None] << 32 | others).ravel())
            times.append((n[:, None] * m).ravel())
            parts.append(np.full(len(keys[-1]), self.part_of_group[g]))
        return np.concatenate(parts), np.concatenate(keys), np.concatenate(times)

    def written(self, names: tuple) -> list[bytes]:
        """The groups of each part as text, every group with its end mark."""
        a_inner, a_last, b_inner, b_last = names
        n_a, n_b = len(self.a), len(self.b)
        ends_a = np.append(self.group_a[1:] != self.group_a[:-1], True) if n_a else np.zeros(0, bool)
        ends_b = np.append(self.group_b[1:] != self.group_b[:-1], True) if n_b else np.zeros(0, bool)
        flat = np.empty(n_a + n_b, dtype=object)
        before_b = np.cumsum(self.in_b) - self.in_b
        upto_a = np.cumsum(self.in_a)
        flat[np.arange(n_a) + before_b[self.group_a]] = np.where(ends_a, a_last[self.a], a_inner[self.a])
        flat[np.arange(n_b) + upto_a[self.group_b]] = np.where(ends_b, b_last[self.b], b_inner[self.b])
        flat = flat.tolist()
        cuts = (self.part_a + self.part_b).tolist()
        return [b"".join(flat[i:j]) for i, j in zip(cuts, cuts[1:])]


def written_ids(n_a: int, n_b: int) -> tuple:
    """Every id in decimal with the mark that follows it inside and at the end of its side."""
    return tuple(
        np.array([b"%d%b" % (i, mark) for i in range(n)], dtype=object) for n, mark in ((n_a, b","), (n_a, b"|"), (n_b, b","), (n_b, b";"))
    )


def _bundles(paths: tuple[str, str]):
    """A function from documents (doc_id, text) to bundles."""

    def run(batches):
        both = kept_by_worker(("alignment", *paths), lambda: Tokenizers(*paths))
        task, number = TaskContext.get().partitionId(), 0
        number_of: dict[str, int] = {}
        docs: list[tuple] = []
        held = 0

        def made():
            entries = both.encoded(list(number_of))
            wrong = {i for i, entry in enumerate(entries) if not entry[2]}
            ids, parts = [], []
            for doc_id, own, text in docs:
                if wrong and not wrong.isdisjoint(own.tolist()):
                    mine = [entries[i] for i in own.tolist()]
                    if any(both.spell(mine, side) != b" " + text for side in (0, 1)):
                        own = own[:0]
                ids.append(doc_id)
                parts.append(own)
            sizes = np.array([len(p) for p in parts], dtype="<i8")
            whole = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            # Parts of texts that are not spelt, and of these alone, are left empty.
            used = np.zeros(len(entries), dtype=bool)
            used[whole] = True
            kept = [entry if use else (b"", b"") for entry, use in zip(entries, used.tolist())]
            ids_of = [np.frombuffer(b"".join([e[side] for e in kept]), "<i4") for side in (0, 1)]
            sizes_of = [np.array([len(e[side]) // 4 for e in kept], dtype=np.int64) for side in (0, 1)]
            aligned = Aligned(ids_of[0], sizes_of[0], ids_of[1], sizes_of[1], both.a_lengths, both.b_lengths)
            keys, holders = _held_pairs(aligned, sizes, whole)
            values = [
                [task << 32 | number], [len(keys)], [ids], [sizes.tobytes()], [whole.astype("<i4").tobytes()],
                [ids_of[0].tobytes()], [sizes_of[0].tobytes()], [ids_of[1].tobytes()], [sizes_of[1].tobytes()],
                [keys.tobytes()], [holders.tobytes()],
            ]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BUNDLE)], schema=BUNDLE)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0), batch.column(1)):
                raw = raw.as_buffer().to_pybytes()
                text = raw.decode(errors="replace")
                found = []
                for stretch in stretches(text) if text else ():
                    parts = both.parts(stretch, number_of)
                    for part in {*parts}.difference(number_of):
                        number_of[part] = len(number_of)
                    found.append(np.fromiter(map(number_of.__getitem__, parts), dtype=np.int32, count=len(parts)))
                own = np.concatenate(found) if found else np.zeros(0, np.int32)
                # The text itself is only looked at where the tokens of a part do not spell it.
                docs.append((doc_id.as_py(), own, raw))
                held += len(text) + 64
                if held >= BUNDLE_CHARS:
                    yield made()
                    docs, held, number = [], 0, number + 1
                    number_of = {}
        if docs:
            yield made()

    return run


def _distinct(values: np.ndarray) -> np.ndarray:
    """Different values in order."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _held_pairs(aligned: Aligned, sizes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a bundle in order, and how many of its documents hold each."""
    part, key, _ = aligned.pairs()
    keys = _distinct(key)
    place = np.searchsorted(keys, key)
    n_parts, n_keys = len(aligned.part_a) - 1, max(1, len(keys))
    # Keys of each part once, and parts of each document once.
    own = _distinct(part * n_keys + place)
    part, place = own // n_keys, own % n_keys
    first = np.searchsorted(part, np.arange(n_parts + 1))
    held = _distinct(np.repeat(np.arange(len(sizes)), sizes) * max(1, n_parts) + parts)
    doc, part = held // max(1, n_parts), held % max(1, n_parts)
    holders = np.zeros(len(keys), dtype=np.int64)
    each = first[part + 1] - first[part]
    # Whole documents at a time, so that what is spread out stays small.
    ends = np.searchsorted(doc, np.arange(len(sizes) + 1))
    grown = np.concatenate([[0], np.cumsum(each)])[ends]
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(grown, grown[at] + (1 << 20), "right")) - 1)
        span = slice(ends[at], ends[end])
        n, begin = each[span], first[part[span]]
        spread = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)
        met = _distinct(np.repeat(doc[span], n) * n_keys + place[spread])
        holders += np.bincount(met % n_keys, minlength=len(keys))[: len(keys)]
        at = end
    return keys, holders


def mixed_bits(keys: np.ndarray, round_: int) -> np.ndarray:
    """Well mixed 64-bit numbers, others in every round."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(round_ + 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def slot_of(keys: np.ndarray) -> np.ndarray:
    return (mixed_bits(keys, -1) % np.uint64(SLOTS)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash function: levels of bits, one for each place that a single key takes.

    A key takes the first level at which no other key that is left shares its place. Its number is
    how many bits stand before its own, over all levels.
    """

    def __init__(self, sizes: np.ndarray, bits: bytes):
        self.sizes = sizes
        marks = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: int(sizes.sum())]
        self.marks = marks.astype(bool)
        self.before = np.cumsum(marks, dtype=np.int64) - marks
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For different keys."""
        left, sizes, levels = keys, [], []
        while len(left):
            size = max(8, int(len(left) * ROOM))
            place = (mixed_bits(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        marks = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, dtype=np.int64), np.packbits(marks, bitorder="little").tobytes())

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1, or that of another, for a key that is not one of them."""
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            if not len(left):
                break
            place = start + (mixed_bits(keys[left], level) % np.uint64(size)).astype(np.int64)
            here = self.marks[place]
            found[left[here]] = self.before[place[here]]
            left = left[~here]
        return found

    def checked(self, keys: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """The number of each key, all of which must be known."""
        found = self.number(keys)
        if len(keys) and (found.min() < 0 or (stored[found] != keys).any()):
            raise ValueError("a pair is not among those that were hashed")
        return found

    def packed(self) -> bytes:
        return np.packbits(self.marks, bitorder="little").tobytes()


def _list_keys(batches):
    schema = pa.schema([("key", pa.int64()), ("slot", pa.int64())])
    for batch in batches:
        for held in batch.column(0):
            keys = np.frombuffer(held.as_buffer(), "<i8")
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(slot_of(some))], schema=schema)


HASH_FIELDS = "shard long, sizes binary, bits binary, keys binary"


def _build_hash(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    keys = rows.column("key").to_numpy()
    made = PerfectHash.of(keys)
    stored = np.empty(len(keys), dtype="<i8")
    stored[made.number(keys)] = keys
    return pa.table({"shard": pa.array([group[0].as_py()], pa.int64()), "sizes": pa.array([made.sizes.tobytes()], pa.binary()),
                     "bits": pa.array([made.packed()], pa.binary()), "keys": pa.array([stored.tobytes()], pa.binary())})


def _hash_in(facts: pa.Table) -> tuple[PerfectHash, np.ndarray]:
    sizes, bits, keys = (facts.column(name)[0].as_buffer() for name in ("sizes", "bits", "keys"))
    return PerfectHash(np.frombuffer(sizes, "<i8"), bits.to_pybytes()), np.frombuffer(keys, "<i8")


def _sum_group(group: tuple[pa.Scalar, ...], asks: pa.Table, facts: pa.Table) -> pa.Table:
    """A dense vector of the counts that some bundles have in a shard."""
    known, stored = _hash_in(facts)
    total = np.zeros(len(stored), dtype="<i8")
    for keys, holders in zip(asks.column("keys"), asks.column("holders")):
        at = known.checked(np.frombuffer(keys.as_buffer(), "<i8"), stored)
        total[at] += np.frombuffer(holders.as_buffer(), "<i8")
    shard, part = (k.as_py() for k in group)
    return pa.table({"shard": pa.array([shard], pa.int64()), "part": pa.array([part], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def _add_group(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), "<i8") for c in rows.column("counts"))
    shard, part = (k.as_py() for k in group)
    return pa.table({"shard": pa.array([shard], pa.int64()), "part": pa.array([part], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def _answer_group(group: tuple[pa.Scalar, ...], asks: pa.Table, facts: pa.Table) -> pa.Table:
    """What the bundles asked of a shard, in the order of their keys."""
    known, stored = _hash_in(facts)
    counts = np.frombuffer(facts.column("counts")[0].as_buffer(), "<i8")
    found = [counts[known.checked(np.frombuffer(k.as_buffer(), "<i8"), stored)].astype("<i8").tobytes() for k in asks.column("keys")]
    return pa.table({"bundle": asks.column("bundle"), "shard": pa.array([group[0].as_py()] * len(found), pa.int64()), "counts": pa.array(found, pa.binary())})


def _best_of_shard(batches):
    """a, best: the highest count of each id of the first tokenizer in a shard."""
    schema = pa.schema([("a", pa.int64()), ("best", pa.int64())])
    for batch in batches:
        for keys, counts in zip(batch.column(0), batch.column(1)):
            a, count = np.frombuffer(keys.as_buffer(), "<i8") >> 32, np.frombuffer(counts.as_buffer(), "<i8")
            ids, place = np.unique(a, return_inverse=True)
            best = np.zeros(len(ids), dtype=np.int64)
            np.maximum.at(best, place, count)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], schema=schema)


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


class Counted:
    """The counts of all pairs of a corpus, in shards, and what is needed to ask for them."""

    def __init__(self, bundles: DataFrame):
        self.bundles = bundles
        keys = cut(bundles.select("keys").mapInArrow(_list_keys, "key long, slot long").distinct())
        self.shards = max(LEAST_SHARDS, -(-keys.count() // KEYS_PER_SHARD))
        parts = max(1, -(-bundles.count() // BUNDLES_PER_SUM))
        shard = F.pmod("slot", F.lit(self.shards)).alias("shard")
        hashes = cut(keys.select("key", shard).groupBy("shard").applyInArrow(_build_hash, HASH_FIELDS))
        self.asks = _stored(bundles.select("bundle", "keys", "holders").mapInArrow(self._ask(parts), "shard long, part long, bundle long, keys binary, holders binary"), "asks")
        sums = self._with(hashes, parts, _sum_group, "shard long, part long, counts binary", ["keys", "holders"])
        self.parts = parts
        while parts > 1:
            parts = -(-parts // FAN_IN)
            sums = cut(sums).withColumn("part", F.expr(f"part div {FAN_IN}"))
            sums = sums.groupBy("shard", "part").applyInArrow(_add_group, "shard long, part long, counts binary")
        self.table = cut(hashes.join(cut(sums.select("shard", "counts")), "shard"))

    def _ask(self, parts: int):
        shards = self.shards

        def run(batches):
            for batch in batches:
                for bundle, held, n in zip(*(batch.column(i) for i in range(3))):
                    bundle, keys, holders = bundle.as_py(), np.frombuffer(held.as_buffer(), "<i8"), np.frombuffer(n.as_buffer(), "<i8")
                    order, starts = by_shard(keys, shards)
                    found = np.flatnonzero(np.diff(starts))
                    rows = [order[starts[s] : starts[s + 1]] for s in found]
                    part = int(mixed_bits(np.array([bundle]), 0)[0] % np.uint64(parts))
                    columns = [found, [part] * len(rows), [bundle] * len(rows), [keys[r].tobytes() for r in rows], [holders[r].tobytes() for r in rows]]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    names = ["shard", "part", "bundle", "keys", "holders"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        return run

    def _with(self, facts: DataFrame, parts: int, function, fields: str, columns: list[str]) -> DataFrame:
        """function over what some bundles ask of a shard and the facts of the shard."""
        copies = facts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        asks = self.asks.select("shard", "part", *columns).groupBy("shard", "part")
        return asks.cogroup(copies.groupBy("shard", "part")).applyInArrow(function, fields)

    def answers(self) -> DataFrame:
        return self._with(self.table, self.parts, _answer_group, "bundle long, shard long, counts binary", ["bundle", "keys"])

    def best(self) -> dict[int, int]:
        """The highest count of each id of the first tokenizer; at most one row per id of its vocabulary."""
        rows = self.table.select("keys", "counts").mapInArrow(_best_of_shard, "a long, best long").groupBy("a").agg(F.max("best").alias("best"))
        return {r.a: r.best for r in rows.collect()}


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by shard, and where each shard begins in it."""
    shard = slot_of(keys) % shards
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def bundled(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(row_of(id_col, text_col)[0].cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    made = rows.mapInArrow(_bundles((path_a, path_b)), BUNDLE_FIELDS)
    # Bucketed, so that what the bundles asked for comes to them where they lie.
    spark, name = docs.sparkSession, f"cadenza_aligned_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "bundle").option("compression", "zstd").option("path", new_path(spark, "aligned")).saveAsTable(name)
    held = spark.table(name)
    # The files stay, and the plan knows them; the name is not needed any more.
    spark.sql(f"DROP TABLE {name}")
    return held


def _scored(paths: tuple[str, str], shards: int, best):
    def run(bundle: pa.Table, answers: pa.Table) -> pa.Table:
        both = kept_by_worker(("alignment", *paths), lambda: Tokenizers(*paths))
        if not hasattr(both, "written"):
            both.written = written_ids(len(both.a_bytes), len(both.b_bytes))
        row = {name: bundle.column(name)[0] for name in BUNDLE.names if name not in ("bundle", "n_keys", "holders")}
        a, b, parts = (np.frombuffer(row[n].as_buffer(), "<i4") for n in ("a_ids", "b_ids", "parts"))
        a_sizes, b_sizes, sizes, keys = (np.frombuffer(row[n].as_buffer(), "<i8") for n in ("a_sizes", "b_sizes", "sizes", "keys"))
        count = np.zeros(len(keys), dtype=np.int64)
        order, starts = by_shard(keys, shards)
        for shard, counts in zip(answers.column("shard").to_pylist(), answers.column("counts")):
            count[order[starts[shard] : starts[shard + 1]]] = np.frombuffer(counts.as_buffer(), "<i8")
        # The second pass over the documents: the same alignment, now with counts.
        aligned = Aligned(a, a_sizes, b, b_sizes, both.a_lengths, both.b_lengths)
        part, key, times = aligned.pairs()
        met = count[np.searchsorted(keys, key)]
        table = best.value
        per_part = [
            a_sizes, b_sizes, aligned.by_part(np.ones(len(aligned.links), np.int64)), aligned.by_part(aligned.links),
            aligned.by_part(times * (met == table[key >> 32]), part), aligned.by_part(times * met, part),
        ]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        columns = [row["doc_ids"].as_py()]
        for values in per_part:
            total = np.zeros(len(sizes), dtype=np.int64)
            np.add.at(total, owner, values[parts])
            columns.append(total)
        texts = aligned.written(both.written)
        ends = np.cumsum(sizes).tolist()
        listed = parts.tolist()
        digests = []
        for start, end in zip([0, *ends], ends):
            digest = sha256()
            # In runs, so that the text of a long document is never whole.
            for at in range(start, end, 1 << 16):
                piece = b"".join(map(texts.__getitem__, listed[at : min(end, at + (1 << 16))]))
                digest.update(piece if at + (1 << 16) < end else piece[:-1])
            digests.append(digest.hexdigest() if end > start else "")
        columns.append(digests)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    path_a: a byte-level vocabulary of the tokenizers library; path_b: a sentencepiece model.
    """
    bundles = bundled(docs, path_a, path_b, id_col, text_col)
    counted = Counted(bundles)
    found = counted.best()
    table = np.zeros(1 + max(found, default=0), dtype=np.int64)
    table[list(found)] = list(found.values())
    # One number per id of the first vocabulary.
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return bundles.groupBy("bundle").cogroup(counted.answers().groupBy("bundle")).applyInArrow(
        _scored((path_a, path_b), counted.shards, shared), RESULT_FIELDS
    )


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n_docs: every pair of linked ids and how many documents hold it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_docs", pa.int64())])

    def listed(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                key, n = np.frombuffer(keys.as_buffer(), "<i8"), np.frombuffer(counts.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n)], schema=schema)

    found = Counted(bundled(docs, path_a, path_b, id_col, text_col))
    return found.table.select("keys", "counts").mapInArrow(listed, "a long, b long, n_docs long")


send_with_tasks(__name__)
