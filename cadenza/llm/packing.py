"""Packing of documents into as few token sequences as possible.

Only token counts matter for the packing, and a count lies between 1 and the sequence length, so the
whole corpus is first reduced to how many pieces there are of every length. On these numbers a
dominance reduction after Martello and Toth fixes small sets: a piece together with partners that no
other set containing that piece can beat. The reduced instance is packed by best fit, longest first.
Both work on all pieces of a length at once. The result is a plan of bounded size (its rows depend
on the sequence length only, not on the corpus): pieces of one length and a range of ranks go to
consecutive sequences at one offset. Pieces are ranked within their length in blocks, and each finds
its range.

Defined results:
- A missing or empty text is the end token alone. A text of any length is encoded in stretches.
- The tokenizer's special tokens are such also where they stand in a text.
- Rows that share a doc_id are documents of their own; ties in length are ranked by a hash of id and
  token ids, which has no effect on the number of sequences.
- An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from unicodedata import is_normalized
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, kept_by_worker, rows_in, stretches, utf8
from cadenza.session import cut, send_with_tasks

END_ID = 1
# Words kept with their ids by each Python worker, twice at most; longer words are not kept.
KEPT_WORDS = 300_000
KEPT_BYTES = 48
BLOCK = 2000
# A character that is a token of its own.
BORDER = "\x00"


class WordEncoder:
    """Token ids, as little-endian 32-bit numbers, of texts by a tokenizer that never joins words.

    The tokenizer drops white space and cuts there, so a text is encoded word by word and every
    word once. It also cuts between letters and a point or comma, and ignores case: a word of
    letters is looked up in lower case and without them, and needs no normalizing when it is new.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.general = Tokenizer.from_file(path)
        # Special tokens in a text are tokens, as by the library's own settings; text is cut there.
        added = self.general.get_added_tokens_decoder()
        self.special = {t.content.encode(): np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self.cuts = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")")
        self.general.encode_special_tokens = True
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.border = self._ids(self.general, BORDER)[0]
        self.ends = {end: np.array(self._ids(self.general, end), dtype="<u4").tobytes() for end in ("", ".", ",")}
        # Two generations: words not met again while one fills up are forgotten.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encoded(self, tokenizer, words: list[str]) -> list[bytes]:
        """The ids of each word, from one call over all of them with a border in between."""
        if not words:
            return []
        ids = np.array(self._ids(tokenizer, f" {BORDER} ".join(words)), dtype="<u4")
        borders = 4 * np.flatnonzero(ids == self.border)
        if len(borders) != len(words) - 1:
            return [np.array(self._ids(tokenizer, w), dtype="<u4").tobytes() for w in words]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(borders + 4).tolist()], [*borders.tolist(), len(raw)])]

    def encode(self, text: bytes) -> bytes:
        if any(token in text for token in self.special):
            return b"".join(self.special.get(part) or self._encode_plain(part) for part in self.cuts.split(text))
        return self._encode_plain(text)

    def _encode_plain(self, text: bytes) -> bytes:
        return b"".join(map(self._encode_words, map(bytes.split, stretches(text))))

    def _learn(self, words: list[bytes]) -> None:
        young, old = self.young, self.old
        other, plain, waiting = [], {}, []
        for word in words:
            text = word.decode()
            end = text[-1] if text[-1] in ".," else ""
            base = text.removesuffix(end)
            lower = base if base.islower() else base.lower()
            # Lower-casing a whole word differs from doing so letter by letter for these only.
            if not base.isalpha() or len(lower) != len(base) or "\u03a3" in base or not is_normalized("NFC", base):
                other.append(word)
                continue
            key = lower.encode()
            ids = young.get(key) or old.get(key)
            if ids is None:
                plain[lower] = key
                waiting.append((word, key, end))
            else:
                young[key] = ids
                young[word] = ids + self.ends[end]
        young.update(zip(plain.values(), self._encoded(self.plain, list(plain))))
        for word, key, end in waiting:
            young[word] = young[key] + self.ends[end]
        young.update(zip(other, self._encoded(self.general, [w.decode() for w in other])))

    def _encode_words(self, words: list[bytes]) -> bytes:
        young, old, new = self.young, self.old, []
        for word in {*words}.difference(young):
            ids = old.get(word)
            if ids is None:
                new.append(word)
            else:
                young[word] = ids
        self._learn(new)
        encoded = b"".join(map(young.__getitem__, words))
        for word in new:
            if len(word) > KEPT_BYTES:
                young.pop(word.decode().rstrip(".,").lower().encode(), None)
                young.pop(word, None)
        if len(young) > KEPT_WORDS:
            self.old, self.young = young, {}
        return encoded


def token_pieces(docs: DataFrame, tokenizer: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document with its end token."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        encoder = kept_by_worker(("words", tokenizer), lambda: WordEncoder(tokenizer))

        def found():
            for doc_id, text in rows_in(batches):
                ids = encoder.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at : at + 4 * most]
                    yield doc_id, piece, at // 4, len(part) // 4, crc32(part)

        yield from batches_of(found(), schema, 5000)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Instance:
    """How many pieces of every length are left, and the plan made of them so far.

    A plan row (length, first_rank, n, first_sequence, offset) sends n pieces of a length, from a
    rank on, to n consecutive sequences, at the same offset in each.
    """

    def __init__(self, counts: dict[int, int], most: int):
        if any(not 1 <= length <= most for length in counts):
            raise ValueError("a length is outside the sequence")
        self.most = most
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)
        self.used: dict[int, int] = defaultdict(int)
        self.plan: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def place(self, length: int, n: int, first_sequence: int, offset: int) -> None:
        self.plan.append((length, self.used[length], n, first_sequence, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def open(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def longest(self, room: int, without: tuple[int, ...] = ()) -> int:
        """The longest length up to `room` with a piece beside those in `without`; 0 if none."""
        i = bisect_left(self.lengths, room + 1) - 1
        while i >= 0:
            length = self.lengths[i]
            if self.left[length] > without.count(length):
                return length
            i -= 1
        return 0

    def shortest(self, n: int, without: tuple[int, ...], above: int = 0) -> list[int]:
        """The n shortest pieces longer than `above`, without those in `without`."""
        found: list[int] = []
        for length in self.lengths[bisect_left(self.lengths, above + 1) :]:
            found += [length] * min(n - len(found), self.left[length] - without.count(length))
            if len(found) >= n:
                break
        return found


def dominating(left: Instance, length: int) -> list[int] | None:
    """The partners of a piece in a set that dominates all sets containing the piece, else None.

    A set dominates another if the partners in the other can be exchanged for its own, each group
    against one that is no shorter.
    """
    room = left.most - length
    mine = (length,)
    fit, total = 0, 0
    for other in left.shortest(3, mine):
        total += other
        fit += total <= room
    if not fit:
        return []
    first = left.longest(room, mine)
    # A partner that fills the room beats everything; so does the longest one if two never fit.
    if first == room or fit == 1:
        return [first]
    if fit == 2:
        second = left.longest(room - first, (length, first))
        # Another pair would need both its pieces longer than the second.
        rivals = left.shortest(2, mine, above=second)
        if second and (len(rivals) < 2 or sum(rivals) > room):
            return [first, second]
    return None


def reduce(left: Instance) -> None:
    """Fix dominating sets, longest pieces first, until no piece has one."""
    moved = True
    while moved:
        moved = False
        for length in sorted(left.lengths, reverse=True):
            while length in left.left:
                partners = dominating(left, length)
                if partners is None:
                    break
                group = [length, *partners]
                # Removing pieces never makes another set better, so equal sets are fixed together.
                n = min(left.left[x] // group.count(x) for x in group)
                first, offset = left.open(n), 0
                for x in group:
                    left.place(x, n, first, offset)
                    offset += x
                moved = True


def best_fit(left: Instance) -> None:
    """Pack what is left, longest pieces first, each into the fullest sequence that takes it."""
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of sequences with it
    rooms: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not groups[room]:
                rooms.insert(bisect_left(rooms, room), room)
            groups[room].append((first, n))

    for length in sorted(left.lengths, reverse=True):
        while length in left.left:
            i = bisect_left(rooms, length)
            n = left.left[length]
            if i == len(rooms):
                put(left.most, left.open(most_opened := -(-n // (left.most // length))), most_opened)
                i = len(rooms) - 1
            room = rooms[i]
            first, held = groups[room].pop()
            if not groups[room]:
                rooms.pop(i)
            # As many into one sequence as fit, so that a run is opened or split once.
            each = min(room // length, max(1, n // held))
            taken = min(held, n // each)
            for k in range(each):
                left.place(length, taken, first, left.most - room + k * length)
            put(room - each * length, first, taken)
            put(room, first + taken, held - taken)


def packing_plan(counts: dict[int, int], most: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan for pieces of given lengths and the number of sequences."""
    left = Instance(counts, most)
    reduce(left)
    best_fit(left)
    return left.plan, left.sequences


def ranked(pieces: DataFrame, block: int) -> DataFrame:
    """Add the 0-based rank of each piece within its length, counted in blocks of about `block`."""
    order = F.xxhash64("doc_id", "start", "ids_crc32")
    parts = pieces.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    # At most one row per length, and no more lengths than tokens in a sequence.
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("block", F.pmod(order, "parts"))
    sizes = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "block", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy(order, "doc_id", "start", "ids_crc32")
    rows = dealt.withColumn("rank", F.row_number().over(inside) - 1)
    return rows.join(starts, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("before")).drop(
        "block", "before", "parts"
    )


def pack(pieces: DataFrame, most: int = 4096, block: int = BLOCK) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = packing_plan(counts, most)
    rows = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    place = pieces.sparkSession.sparkContext.broadcast(rows)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema(
        [(n, pa.int32() if n == "piece" else pa.int64()) for n in names] + [("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def run(batches):
        plan = place.value
        # A length and a rank as one number; ranks stay below 2**48.
        keys = plan[:, 0] << 48 | plan[:, 1]
        for batch in batches:
            columns = [batch.column(n) for n in names]
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            sequence = pa.array(row[:, 3] + rank - row[:, 1])
            yield pa.RecordBatch.from_arrays([*columns, sequence, pa.array(row[:, 4])], schema=schema)

    with_rank = ranked(pieces, block).select(*names, F.col("rank").cast("long").alias("rank"))
    return with_rank.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, most: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there."""
    return pack(cut(token_pieces(docs, tokenizer, most, id_col, text_col)), most)


send_with_tasks(__name__)
