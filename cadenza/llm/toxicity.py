"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary and one on windows of toxic text. A
document is read in lower case and cut into windows of WIDE_WORDS words, or WIDE_CHARS characters of
text in scripts without blanks. Each is compressed with either dictionary, and the bytes that the
toxic one saves are compared with calibrated log-likelihood ratios.

Where a few words of an otherwise ordinary document are toxic, that tells little (see the README). So
there is an extra to the method: the words and pairs of words that set toxic documents apart are put
behind the ordinary dictionary, and narrow windows, which are single words, those pairs, or GRAM
characters of text without blanks, are compressed without and with them. They are set in two
contexts from ordinary text, so that a few bytes of difference show. Their pairs of lengths are
calibrated like those of the wide windows.

A logistic regression turns the mean and scaled sum of the ratios and the numbers of windows above two
thresholds, of wide and of narrow windows, into a score.

Training uses a bounded sample of labelled rows, those of the smallest hashes of doc_id: at most
`most_toxic` and `most_ordinary` documents, and of their windows the `most_windows` of the smallest
hashes for each dictionary. The words that set toxic documents apart fill `most_bytes` and the pairs
half as much, the most frequent ones first. A dictionary cannot be trained on less than 20 times its size; then the end of
the sample itself is the dictionary. Calibration is crossed: the documents of each fold are
compressed with a toxic dictionary made of the other folds. The one for scoring is made of all.
Scoring reads whole texts, in stretches; a Python worker compresses a word it has met before only if
it has forgotten it.

Defined results:
- A missing or empty text has a single empty window and gets a score like any other.
- A missing label, or a label without a document, is not used. A doc_id labelled twice is toxic if
  any of its labels is. Rows that share a doc_id are scored one by one. A missing doc_id is kept.
- Without toxic or without ordinary examples, every score is the share of toxic ones, 0 if there are
  no labels. An empty table gives an empty result.
- Columns of the input keep their place; one named like a result is replaced.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import batches_of, kept_by_worker, rows_in, stretches, utf8, with_columns_replaced
from cadenza.session import cut, send_with_tasks

PUNCTUATION = string.punctuation.encode()
# Punctuation to blanks, byte by byte.
READ = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
# Runs of scripts that are written without blanks, and their marks.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
MARKS = re.compile("[\u2010-\u2027\u3000-\u3003\u3008-\u301f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
LONGEST = 40
WIDE_WORDS = 32
WIDE_CHARS = 64
GRAM = 4
LEAST_GRAM = 2
# Lengths above that of a known word, counted up to this one, and below it.
CELLS = 48
BELOW = 4
# Bytes saved on a wide window, counted up to this many either way.
SAVED = 24
# Fewer added words than these say little of what a known word costs.
FEW_WORDS = 64
ORDINARY_BYTES = 32 << 10
TRAINED_BYTES = 32 << 10
CONTEXT = 64
CONTEXTS = (0.25, 0.6)
WINDOW_BYTES = 256
KEPT_WORDS = 300_000
LEAST_DOCS = 3
RATIO = 20.0
STEPS = (1.0, 2.0)
LONG_WORD = 8
DOUBT = 5.0
FOLDS = 4


def _short(word: bytes) -> list[bytes]:
    """A long word in pieces of at most LONGEST bytes that end between characters."""
    pieces = []
    while len(word) > LONGEST:
        end = LONGEST
        while end > LONGEST - 4 and word[end] & 0xC0 == 0x80:
            end -= 1
        pieces.append(word[:end])
        word = word[end:]
    return [*pieces, word]


def read(text: bytes):
    """The words of a text, stretch by stretch, without case and punctuation, and its unspaced runs."""
    for part in stretches(text):
        runs = []
        if part.isascii():
            part = part.lower()
        else:
            known = MARKS.sub(" ", part.decode(errors="replace").lower())
            runs = UNSPACED.findall(known)
            part = (UNSPACED.sub(" ", known) if runs else known).encode()
        words = part.translate(READ).split()
        if max(map(len, words), default=0) > LONGEST:
            words = [piece for w in words for piece in _short(w)]
        yield words, runs


def grams(run: str, size: int) -> list[bytes]:
    """All windows of `size` characters of a run, which is a window itself if it is shorter."""
    return [run[i : i + size].encode() for i in range(max(1, len(run) - size + 1))]


def windows(text: bytes, phrases: frozenset[tuple[bytes, ...]] = frozenset()):
    """Narrow and wide windows of a text, stretch by stretch.

    Narrow ones are its words, long ones in pieces, those of the given pairs that it has, and every GRAM
    characters of unspaced runs."""
    last: list[bytes] = []
    for words, runs in read(text):
        found = words + [w for run in runs for w in grams(run, GRAM)]
        if phrases:
            # Pairs go on over the ends of stretches.
            whole = last + words
            found += map(b" ".join, filter(phrases.__contains__, zip(whole, whole[1:])))
            last = words[-1:] or last
        yield found, wide_windows(words, runs)


def wide_windows(words: list[bytes], runs: list[str]):
    """Windows of WIDE_WORDS words, and of WIDE_CHARS characters of unspaced runs, one after the other."""
    for i in range(0, len(words), WIDE_WORDS):
        yield b" ".join(words[i : i + WIDE_WORDS])
    for run in runs:
        yield from (run[i : i + WIDE_CHARS].encode() for i in range(0, len(run), WIDE_CHARS))


def units(text: bytes) -> set[bytes]:
    """What may set toxic documents apart: words, pairs of words, and short runs of unspaced characters."""
    found = set()
    for words, runs in read(text):
        found.update(w for w in words if 3 <= len(w) < LONGEST)
        found.update(b"%b %b" % pair for pair in zip(words, words[1:]))
        found.update(w for run in runs for size in range(LEAST_GRAM, GRAM + 1) for w in grams(run, size))
    return found


KINDS = (slice(0, CELLS * CELLS), slice(CELLS * CELLS, CELLS * CELLS + 2 * SAVED))


@dataclass
class Model:
    """Dictionaries, log-likelihood ratio of every pair of lengths, and the weights of the score."""

    ordinary: bytes
    toxic: bytes
    phrases: frozenset[bytes]
    ratios: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray


class Lengths:
    """The pair of compressed lengths of a narrow window, as one number; the bytes saved on wide ones follow."""

    def __init__(self, ordinary: bytes, toxic: bytes, phrases: frozenset[bytes] = frozenset()):
        self.phrases = frozenset(tuple(p.split(b" ")) for p in phrases)
        # From all over the dictionary, as one context may swallow a byte that another shows; not from
        # its end, which cannot be referred to.
        starts = [int(max(0, len(ordinary) - 2 * CONTEXT) * place) for place in CONTEXTS]
        self.contexts = [ordinary[at : at + CONTEXT] for at in starts]
        # The added words follow the last end of a line.
        trained, _, added = toxic.rpartition(b"\n")
        self.by_ordinary, self.by_both = map(self._compressor, (ordinary, ordinary + added))
        self.wide = self._compressor(ordinary, False), self._compressor(trained, False)
        self.base = self._known(ordinary, 0), self._known(added if len(added.split()) >= FEW_WORDS else ordinary, 1)
        # Two generations: words not met again while one fills up are forgotten.
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes, narrow: bool = True):
        # As it was trained, with its tables, for wide windows; a search for the best of all matches in
        # the content alone for narrow ones, which are compressed once.
        kind = zstandard.DICT_TYPE_RAWCONTENT if narrow else zstandard.DICT_TYPE_AUTO
        held = zstandard.ZstdCompressionDict(content, dict_type=kind)
        strategy, search_log = (zstandard.STRATEGY_BTLAZY2, 8) if narrow else (zstandard.STRATEGY_FAST, 1)
        shape = zstandard.ZstdCompressionParameters(
            strategy=strategy, min_match=4, window_log=17, hash_log=17, chain_log=17, search_log=search_log,
            write_checksum=0, write_content_size=0, write_dict_id=0,
        )
        held.precompute_compress(compression_params=shape)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=shape).compress

    def _sizes(self, word: bytes) -> tuple[int, int]:
        """Lengths by either dictionary, summed over the contexts."""
        a = b = 0
        for context in self.contexts:
            # The end of an input is never matched, so the word stands in the middle of the context.
            window = b"%b %b %b" % (context[: CONTEXT // 2], word, context[CONTEXT // 2 :])
            a += len(self.by_ordinary(window))
            b += len(self.by_both(window))
        return a, b

    def _known(self, content: bytes, which: int) -> int:
        """What a word costs that a dictionary holds: the middle of a few of its own words.

        Lengths are counted from there, so that those of different dictionaries can be compared.
        """
        own = sorted({w for w in content.split() if 4 <= len(w) <= 12})[:: max(1, len(content) // 4096)]
        sizes = sorted(self._sizes(w)[which] for w in own) or [self._sizes(b"")[which]]
        return sizes[len(sizes) // 2] - BELOW

    def cell(self, word: bytes) -> int:
        a, b = (min(max(size - base, 0), CELLS - 1) for size, base in zip(self._sizes(word), self.base))
        return a * CELLS + b

    def wide_cell(self, window: bytes) -> int:
        saved = len(self.wide[0](window)) - len(self.wide[1](window))
        return KINDS[1].start + min(max(saved + SAVED, 0), 2 * SAVED - 1)

    def counts(self, text: bytes) -> np.ndarray:
        """How many windows of a text fall into each pair of lengths, and into each number of saved bytes."""
        total = np.zeros(KINDS[1].stop, dtype=np.int64)
        for words, wide in windows(text, self.phrases):
            cells = np.fromiter(map(self.wide_cell, wide), dtype=np.int64)
            total += np.bincount(cells, minlength=len(total))
            young = self.young
            for word in {*words}.difference(young):
                known = self.old.get(word)
                young[word] = self.cell(word) if known is None else known
            cells = np.fromiter(map(young.__getitem__, words), dtype=np.int64, count=len(words))
            total += np.bincount(cells, minlength=len(total))
            if len(young) > KEPT_WORDS:
                self.old, self.young = young, {}
        if not total.any():
            total[self.cell(b"")] = 1
        return total


def _features(n, total, above) -> np.ndarray:
    """Mean and scaled sum of the ratios, numbers of windows above the steps, number of windows."""
    n = np.maximum(n, 1.0)
    return np.concatenate([np.stack([total / n, total / np.sqrt(n)], axis=-1), np.log1p(above), np.log1p(n)[..., None]], axis=-1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the constant first, by Newton's method with a penalty on all but the constant."""
    x = np.c_[np.ones(len(x)), x]
    ridge = penalty * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_of(model: Model, counts: np.ndarray) -> float:
    if not len(model.scales):
        return float(model.weights[0])
    found = []
    for kind in KINDS:
        n, ratios = counts[kind], model.ratios[kind]
        above = np.array([n @ (ratios > step) for step in STEPS], dtype=np.float64)
        found.append(_features(np.float64(n.sum()), n @ ratios, above))
    x = (np.concatenate(found) - model.means) / model.scales
    return float(1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30))))


def training_sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_ordinary: int) -> DataFrame:
    """doc_id, toxic, fold, sign, text of a bounded sample of labelled documents."""
    named = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = named.join(docs.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id") == F.col("__id"), "left_semi")
    order = F.xxhash64("doc_id")
    chosen = [
        named.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)
        for label, most in ((1, most_toxic), (0, most_ordinary))
    ]
    sample = cut(chosen[0].union(chosen[1]).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")))
    # At most most_toxic + most_ordinary rows go to all tasks.
    met = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", "toxic", "text")
    return met.mapInArrow(_signed, "doc_id long, toxic int, fold int, sign long, text binary")


def _signed(batches):
    """Add the least hash of a text's long words, which copies share, and a fold that follows from it."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("toxic", pa.int32()), ("fold", pa.int32()), ("sign", pa.int64()), ("text", pa.binary())]
    )

    def found():
        for doc_id, toxic, text in rows_in(batches):
            words = {w for part, _ in windows(text) for w in part}
            sign = min((xxhash.xxh32_intdigest(w) for w in words if len(w) >= LONG_WORD), default=xxhash.xxh32_intdigest(text))
            yield doc_id, toxic, xxhash.xxh32_intdigest(str(sign)) % FOLDS, sign, text

    yield from batches_of(found(), schema, 500)


def _words_of_documents(batches):
    """toxic, fold, sign, word or pair once for every document, without the pieces of long words."""
    schema = pa.schema([("toxic", pa.int32()), ("fold", pa.int32()), ("sign", pa.int64()), ("word", pa.binary())])

    def found():
        for toxic, fold, sign, text in rows_in(batches):
            yield from zip(repeat(toxic), repeat(fold), repeat(sign), units(text))

    yield from batches_of(found(), schema, 50_000)


def _windows_of_documents(batches):
    """Stretches of the read text, as samples for the dictionaries, with the fold of the document."""
    schema = pa.schema([("fold", pa.int32()), ("window", pa.binary())])

    def found():
        for fold, text in rows_in(batches):
            for words, runs in read(text):
                joined = b" ".join([*words, *[run.encode() for run in runs]])
                yield from ((fold, joined[i : i + WINDOW_BYTES]) for i in range(0, len(joined), WINDOW_BYTES))

    yield from batches_of(found(), schema, 5000)


def _counted_words(sample: DataFrame) -> DataFrame:
    """word and, by fold, the numbers of toxic (hits) and other documents with it; copies count once."""
    words = sample.select("toxic", "fold", "sign", "text").mapInArrow(
        _words_of_documents, "toxic int, fold int, sign long, word binary"
    ).distinct()
    sums = [
        F.sum(F.when(F.col("fold") == fold, value).otherwise(0)).alias(f"{name}_{fold}")
        for fold in range(FOLDS)
        for name, value in (("hits", F.col("toxic")), ("others", 1 - F.col("toxic")))
    ]
    counts = words.groupBy("word").agg(*sums)
    counts = counts.filter(sum(F.col(f"hits_{fold}") for fold in range(FOLDS)) >= LEAST_DOCS)
    return counts.withColumn("pair", F.contains("word", F.lit(b" ")))


def _toxic_words(
    counts: DataFrame, folds: list[int], sizes: dict[tuple[int, int], int], most_bytes: int
) -> tuple[bytes, frozenset[bytes]]:
    """The words of toxic documents that are RATIO times as frequent there, the most frequent last,
    as text, and the pairs of words of which that is true but of neither word.

    Pairs come first: what is nearest to the window costs least to refer to.
    """
    hits, others = (sum(F.col(f"{name}_{fold}") for fold in folds) for name in ("hits", "others"))
    n_toxic, n_ordinary = (sum(sizes.get((label, fold), 0) for fold in folds) for label in (1, 0))
    apart = (hits + 0.5) / (n_toxic + 1.0) >= RATIO * (others + 0.5) / (n_ordinary + 1.0)
    found = counts.filter((hits >= LEAST_DOCS) & apart)

    def most_frequent(rows: DataFrame, size: int) -> list[bytes]:
        # No more than there is room for; the shortest take four bytes with their blank.
        listed = [bytes(r.word) for r in rows.orderBy(hits.desc(), "word").limit(size // 4).select("word").collect()]
        fits = np.cumsum([len(w) + 1 for w in listed]) <= size
        return [w for w, fit in zip(listed, fits) if fit]

    pair = F.col("pair")
    words = most_frequent(found.filter(~pair), most_bytes)
    # Pairs with a known word are dropped before any are cut off; the words are bounded as above.
    marks = counts.sparkSession.createDataFrame([(bytearray(w),) for w in words], "known binary")
    halves = F.split(F.decode("word", "UTF-8"), " ")
    pairs = found.filter(pair)
    for at in (0, 1):
        pairs = pairs.join(F.broadcast(marks), halves[at].cast("binary") == F.col("known"), "left_anti")
    phrases = most_frequent(pairs, most_bytes // 2)
    return b" " + b" ".join([*reversed(phrases), *reversed(words)]) + b" ", frozenset(phrases)


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of very little text, the text itself."""
    if sum(map(len, samples)) > 20 * size:
        return zstandard.train_dictionary(size, samples).as_bytes()
    return b" ".join(samples)[-size:]


def train(
    docs: DataFrame,
    labels: DataFrame,
    most_toxic: int = 4000,
    most_ordinary: int = 8000,
    most_windows: int = 32_000,
    most_bytes: int = 64 << 10,
) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic)."""
    texts = docs.select("doc_id", utf8("text").alias("text"))
    sample = cut(training_sample(texts, labels, most_toxic, most_ordinary))
    signs = sample.select("toxic", "fold", "sign").distinct().groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n"))
    sizes = {(r.toxic, r.fold): r.n for r in signs.collect()}
    total = {label: sum(n for (toxic, _), n in sizes.items() if toxic == label) for label in (0, 1)}
    if not total[0] or not total[1]:
        none = np.zeros(0)
        return Model(b"", b"", frozenset(), none, none, none, np.array([total[1] / max(1, sum(total.values()))]))

    def sampled(label: int) -> list:
        read_windows = sample.filter(F.col("toxic") == label).select("fold", "text").mapInArrow(
            _windows_of_documents, "fold int, window binary"
        )
        # Bounded: most_windows rows of at most WINDOW_BYTES.
        return read_windows.orderBy(F.xxhash64("window"), "window", "fold").limit(most_windows).collect()

    toxic_windows = sampled(1)
    counted = cut(_counted_words(sample))

    # One ordinary dictionary for all: it holds far less than a thousandth of the calibrating texts.
    base = _trained([bytes(r.window) for r in sampled(0)], ORDINARY_BYTES)

    def dictionaries(folds: list[int]) -> tuple[bytes, bytes, frozenset[bytes]]:
        own = _trained([bytes(r.window) for r in toxic_windows if r.fold in folds], TRAINED_BYTES)
        added, phrases = _toxic_words(counted, folds, sizes, most_bytes)
        return base, own + b"\n" + added, phrases

    crossed = [dictionaries([other for other in range(FOLDS) if other != fold]) for fold in range(FOLDS)]
    shared = docs.sparkSession.sparkContext.broadcast(crossed)
    schema = pa.schema([("doc", pa.int64()), ("toxic", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())])

    def count(batches):
        lengths = [Lengths(*made) for made in shared.value]

        def found():
            for doc, toxic, fold, text in rows_in(batches):
                counts = lengths[fold].counts(text)
                for cell in np.flatnonzero(counts):
                    yield doc, toxic, int(cell), int(counts[cell])

        yield from batches_of(found(), schema, 10_000)

    rows = sample.select("doc_id", "toxic", "fold", "text").mapInArrow(count, "doc long, toxic int, cell int, n long")
    return _calibrated(*dictionaries(list(range(FOLDS))), cut(rows))


def _calibrated(base: bytes, toxic: bytes, phrases: frozenset[bytes], rows: DataFrame) -> Model:
    """The model of two dictionaries, from rows (doc, toxic, cell, n) of the calibrating documents."""
    by_label = np.zeros((2, KINDS[1].stop))
    for r in rows.groupBy("toxic", "cell").agg(F.sum("n").alias("n")).collect():
        by_label[r.toxic, r.cell] = r.n
    # Of cells that are rarely met, little is said: what either label has is compared with what it
    # would have by chance, after DOUBT windows more of both.
    ratios = np.zeros(KINDS[1].stop)
    for kind in KINDS:
        own = by_label[:, kind]
        chance = own.sum(axis=0) * own.sum(axis=1, keepdims=True) / max(1.0, own.sum())
        apart = np.log((own + DOUBT) / (chance + DOUBT))
        ratios[kind] = np.clip(apart[1] - apart[0], -1, 4)
    known = rows.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(ratios)], "cell int, ratio double")
    sums = []
    for kind in KINDS:
        n = F.when(F.col("cell").between(kind.start, kind.stop - 1), F.col("n")).otherwise(0)
        sums += [F.sum(n), F.sum(n * F.col("ratio"))]
        sums += [F.sum(F.when(F.col("ratio") > step, n).otherwise(0)) for step in STEPS]
    # Bounded by the sample: a row of a few numbers for each of its documents.
    found = rows.join(F.broadcast(known), "cell").groupBy("doc", "toxic").agg(*sums).orderBy("doc", "toxic").collect()
    values = np.array([tuple(r)[1:] for r in found], dtype=np.float64)
    each = 2 + len(STEPS)
    y, kinds = values[:, 0], [values[:, 1 + each * k : 1 + each * (k + 1)] for k in range(len(KINDS))]
    x = np.concatenate([_features(v[:, 0], v[:, 1], v[:, 2:]) for v in kinds], axis=1)
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(base, toxic, phrases, ratios, means, scales, _logistic((x - means) / scales, y))


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with a score (0 to 1, higher: more likely toxic) in the column `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # One value for each row, whatever other columns there are.
    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        known = shared.value
        if not len(known.scales):
            return pd.Series([score_of(known, None)] * len(texts))
        made = known.ordinary, known.toxic, known.phrases
        lengths = kept_by_worker(("lengths", *made), lambda: Lengths(*made))
        return pd.Series([score_of(known, lengths.counts(text)) for text in texts], dtype="float64")

    return with_columns_replaced(docs, **{name: score(utf8(text_col))})


def learn_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the doc_id as text is no multiple of 5."""
    return labels.filter(~held_out("doc_id"))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs (doc_id, text, ...) without those that score `limit` or more, columns as they were."""
    model = train(docs, learn_labels(labels))
    return scored(docs, model, name="__toxicity").filter(F.col("__toxicity") < limit).drop("__toxicity")


send_with_tasks(__name__)
