"""Ranked lexical search by dense matrix multiplication, exact in whole numbers.

Documents are read once. What they hold of the words of the items is written as sparse tiles: term
numbers and counts of a few hundred documents. Sums over the tiles give the statistics. Then tiles are
multiplied: items in tiles with a compact vocabulary of their own, as a matrix of weights times
repeats, and a tile of documents as a dense matrix of impacts, both in float64. All entries are
whole numbers; the vocabulary of an item tile is split wherever the sum over an item could reach
2**53, and the parts are added as 64-bit integers, so every score is exact. A task keeps the best
documents of each item over its tiles, equal scores by ascending doc_id; two more rounds reduce those
of all tasks.

Items go to the tasks in batches of about ITEM_BYTES of text; a larger set of items takes more
passes over the documents, one for each batch.

Defined results:
- A missing or empty text has no terms; such a document or item is in no result. A document of any
  length is read in stretches; of it only the terms of the items are held.
- Rows that share a doc_id are ranked one by one, as are items that share an item_id: every different
  row of items (item_id, text) has ranks of its own. Missing doc_ids come last among equal scores.
- Empty documents or items give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, stretches, utf8
from cadenza.session import cut, new_path, send_with_tasks

# Terms are runs of ASCII letters and digits and of all characters beyond ASCII;
# A-Z count as a-z. The constants of weight and impact.
KEPT = (string.ascii_letters + string.digits).encode()
READ = bytes(c if c >= 128 else ord(chr(c).lower()) if c in KEPT else 32 for c in range(256))
LENGTH_SHARE = 75
IMPACT_SCALE = 1_000_000_000
IMPACT_TF = 1000
IMPACT_LENGTH = 8
WEIGHT_SCALE = 1000
# No impact reaches this.
IMPACT_BOUND = IMPACT_SCALE // IMPACT_TF
EXACT = 1 << 53
NO_ID = 2**63 - 1

ITEM_BYTES = 8 << 20
TILE_ITEMS = 64
# Of documents that are multiplied at once, and of tiles as they are stored.
TILE_DOCS = 256
DENSE_BYTES = 32 << 20
TILE_PAIRS = 1 << 18
MERGE_PARTS = 64
STORED = pa.schema(
    [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()),
     ("starts", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary())]
)
STORED_FIELDS = "n_docs long, n_terms long, doc_ids binary, lengths binary, starts binary, terms binary, counts binary"
FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(READ).split()


def _held(text: bytes, number: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms a text has, and which of the known ones how often."""
    total, parts = 0, []
    for part in stretches(text):
        words = terms_of(part)
        total += len(words)
        ids = np.array([i for i in map(number.get, words) if i is not None], dtype=np.int32)
        parts.append(np.unique(ids, return_counts=True))
    if len(parts) == 1:
        return total, *parts[0]
    found, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return total, found, np.bincount(place, np.concatenate([c for _, c in parts]), len(found)).astype(np.int64)


def stored_tiles(docs: DataFrame, words: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """The documents as sparse tiles over the given words, written to the shared folder.

    A stretch ends after white space, so no term is cut.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        number = {w: i for i, w in enumerate(shared.value)}
        ids, lengths, terms, counts, pairs = [], [], [], [], 0

        def tile():
            starts = np.cumsum([0, *map(len, terms)])
            columns = [
                [len(ids)], [sum(lengths)], [np.array(ids, "<i8").tobytes()], [np.array(lengths, "<i8").tobytes()],
                [starts.astype("<i8").tobytes()], [np.concatenate(terms).astype("<i4").tobytes()],
                [np.concatenate(counts).astype("<i8").tobytes()],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, STORED)], schema=STORED)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                total, found, n = _held(text.as_buffer().to_pybytes(), number)
                if not total:
                    continue
                ids.append(NO_ID if doc_id.as_py() is None else doc_id.as_py())
                lengths.append(total)
                terms.append(found)
                counts.append(n)
                pairs += len(found)
                if pairs >= TILE_PAIRS:
                    yield tile()
                    ids, lengths, terms, counts, pairs = [], [], [], [], 0
        if ids:
            yield tile()

    path = new_path(docs.sparkSession, "tiles")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    rows.mapInArrow(run, STORED_FIELDS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def document_frequencies(tiles: DataFrame, n_words: int) -> np.ndarray:
    """In how many documents each of the words occurs; one row per word reaches the driver."""

    def run(batches):
        total = np.zeros(n_words, dtype=np.int64)
        for batch in batches:
            for terms in batch.column(0):
                total += np.bincount(np.frombuffer(terms.as_buffer(), "<i4"), minlength=n_words)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array(total[held])], schema=pa.schema([("term", pa.int64()), ("n", pa.int64())])
        )

    sums = tiles.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = np.zeros(n_words, dtype=np.int64)
    for r in sums.collect():
        total[r.term] = r.n
    return total


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(length: int, n_docs: int, n_terms: int) -> int:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * length * n_docs) // n_terms


def impact(tf, factor):
    """The share of a term in the score of a document, a whole number below IMPACT_BOUND."""
    return (IMPACT_SCALE * tf) // (IMPACT_TF * tf + IMPACT_LENGTH * factor)


class ItemTile:
    """A few items: which words they use, and matrices of their weights.

    Each of `parts` is a run of columns over which no sum can reach 2**53. A weight too large for
    one column takes several.
    """

    def __init__(self, items: list[tuple[int, Counter]], weights: np.ndarray, exact: int = EXACT):
        self.items = np.array([number for number, _ in items], dtype=np.int64)
        most = (exact - 1) // IMPACT_BOUND
        columns: list[tuple[int, dict[int, int]]] = []
        used = defaultdict(dict)
        for row, (_, words) in enumerate(items):
            for word, repeats in words.items():
                if weights[word]:
                    used[word][row] = repeats * int(weights[word])
        for word, entries in sorted(used.items()):
            while entries:
                columns.append((word, {row: min(v, most) for row, v in entries.items()}))
                entries = {row: v - most for row, v in entries.items() if v > most}
        self.parts = []
        held, sums = [], np.zeros(len(items), dtype=object)
        for word, entries in columns:
            more = np.zeros(len(items), dtype=object)
            more[list(entries)] = list(entries.values())
            if held and (sums + more).max() > most:
                self._close(held, len(items))
                held, sums = [], np.zeros(len(items), dtype=object)
            held.append((word, entries))
            sums += more
        if held:
            self._close(held, len(items))

    def _close(self, columns, n_items: int) -> None:
        words = np.array([word for word, _ in columns], dtype=np.int64)
        matrix = np.zeros((len(columns), n_items))
        for at, (_, entries) in enumerate(columns):
            matrix[at, list(entries)] = list(entries.values())
        self.parts.append((words, matrix))

    def scores(self, dense: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """Scores of documents (rows) for the items, from their impacts; columns has the places there
        of the words of each part."""
        total = np.zeros((len(dense), len(self.items)), dtype=np.int64)
        for chosen, (_, matrix) in zip(columns, self.parts):
            total += (dense[:, chosen] @ matrix).astype(np.int64)
        return total


class Best:
    """The best documents of every item so far, by score and then by the smaller id."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.ids = np.full((n_items, top), NO_ID, dtype=np.int64)
        self.scores = np.zeros((n_items, top), dtype=np.int64)

    def add(self, ids: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        """scores has a row for each of the documents ids, a column for each of the items."""
        last = self.scores[items, -1]
        # A document that only equals the last one may still have the smaller id.
        hopeful = np.flatnonzero(((scores >= last) & (scores > 0)).any(axis=0))
        for at in hopeful:
            item = items[at]
            able = np.flatnonzero((scores[:, at] >= last[at]) & (scores[:, at] > 0))
            all_scores = np.concatenate([self.scores[item], scores[able, at]])
            all_ids = np.concatenate([self.ids[item], ids[able]])
            order = np.lexsort((all_ids, -all_scores))[: self.top]
            self.scores[item], self.ids[item] = all_scores[order], all_ids[order]

    def rows(self):
        for item, place in zip(*np.nonzero(self.scores > 0)):
            found = int(self.ids[item, place])
            yield int(item), None if found == NO_ID else found, int(self.scores[item, place])


def _read_tile(row: dict, n_docs: int, n_terms: int):
    """Of a stored tile: document ids, their first pairs, and the term and impact of each pair."""
    kinds = {"doc_ids": "<i8", "lengths": "<i8", "starts": "<i8", "terms": "<i4", "counts": "<i8"}
    ids, lengths, starts, terms, counts = (np.frombuffer(row[name].as_buffer(), kind) for name, kind in kinds.items())
    factors = np.array([length_factor(n, n_docs, n_terms) for n in lengths.tolist()], dtype=np.int64)
    return ids, starts, terms, impact(counts, np.repeat(factors, np.diff(starts)))


def _best_of_tasks(tiles: DataFrame, item_tiles: list[ItemTile], n_words: int, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item, doc_id, score: the best documents of every task."""
    n_items = 1 + max(int(t.items.max()) for t in item_tiles)
    # Words that count, in a row of numbers of their own.
    words = np.unique(np.concatenate([w for t in item_tiles for w, _ in t.parts] or [np.zeros(0, np.int64)]))
    place = np.full(n_words, -1, dtype=np.int64)
    place[words] = np.arange(len(words))
    shared = tiles.sparkSession.sparkContext.broadcast((item_tiles, place, len(words)))
    names = ["doc_ids", "lengths", "starts", "terms", "counts"]

    def run(batches):
        item_tiles, place, width = shared.value
        best = Best(n_items, top)
        parts = [(tile, [place[w] for w, _ in tile.parts]) for tile in item_tiles]
        at_once = max(1, min(TILE_DOCS, DENSE_BYTES // max(1, 8 * width)))
        for batch in batches:
            for row in range(batch.num_rows):
                held = {name: batch.column(name)[row] for name in names}
                ids, starts, terms, values = _read_tile(held, n_docs, n_terms)
                columns = place[terms]
                for at in range(0, len(ids), at_once):
                    end = min(at + at_once, len(ids))
                    span = slice(starts[at], starts[end])
                    owner = np.repeat(np.arange(end - at), np.diff(starts[at : end + 1]))
                    known = columns[span] >= 0
                    dense = np.zeros((end - at, width))
                    dense[owner[known], columns[span][known]] = values[span][known]
                    for tile, chosen in parts:
                        best.add(ids[at:end], tile.items, tile.scores(dense, chosen))
        yield from batches_of(best.rows(), FOUND)

    return tiles.select(*names).mapInArrow(run, "item long, doc_id long, score long")


def _ranked(tiles: DataFrame, texts: list[bytes], words: list[bytes], top: int, tile_items: int) -> DataFrame:
    """item (place in texts), rank, doc_id, score of the best documents."""
    n_docs, n_terms = tiles.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    frequency = document_frequencies(tiles, len(words))
    # A word that no document holds adds nothing.
    weights = np.array([weight(n_docs, n) if n else 0 for n in frequency.tolist()], dtype=np.int64)
    number = {w: i for i, w in enumerate(words)}
    counted = [(i, Counter(number[w] for w in terms_of(text))) for i, text in enumerate(texts)]
    tiled = [ItemTile(counted[at : at + tile_items], weights) for at in range(0, len(counted), tile_items)]
    found = _best_of_tasks(tiles, tiled, len(words), n_docs, n_terms, top)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # Those of all tasks are first reduced in parts, so that no task gets all of an item.
    some = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("item").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
    tile_items: int = TILE_ITEMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of every item (item_id, text) with score above 0."""
    spark = docs.sparkSession
    asked = cut(items.select(F.col("item_id").cast("long").alias("item_id"), utf8("text").alias("text")).distinct())
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    turns = -(-size // item_bytes)
    turn_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, turns)))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for turn in range(turns):
        rows = [(r.item_id, bytes(r.text)) for r in asked.filter(turn_of == turn).collect()]
        words = sorted({w for _, text in rows for w in terms_of(text)})
        if not words:
            continue
        tiles = stored_tiles(docs, words, id_col, text_col)
        ranked = _ranked(tiles, [text for _, text in rows], words, top, tile_items)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(rows)], "item long, item_id long")
        found = found.union(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return found


send_with_tasks(__name__)
