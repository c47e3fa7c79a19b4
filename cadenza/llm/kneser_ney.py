"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on trusted documents, one model per language. Counts, contexts and
probabilities are tables keyed by language and n-gram, so every join of them is spread over all
tasks and no task holds a model. Documents are put into compressed bundles that are written once,
bucketed by bundle; a bundle asks for each n-gram that occurs in it once, receives the probabilities,
and scores its documents where it lies. A document is rejected if its perplexity is above a
threshold taken from quantiles of the trusted documents of its language.

Defined results:
- A missing or empty text has no perplexity and is rejected.
- A missing language is a language of its own. A language without trusted documents has no threshold:
  its documents are kept.
- Rows that share a doc_id are scored one by one; a label counts for all of them. A missing doc_id is
  kept and never trusted. Without documents the result is empty. Other columns are ignored.
- A text of more than PIECE_CHARS characters is counted and scored in pieces that may lie in several
  bundles; each takes along the characters before it, so the result is that of the whole text.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import join_small, kept_by_worker, row_of
from cadenza.session import cut, new_path, send_with_tasks

ORDER = 4
# Characters before the beginning of a text.
PAD = "\x02"
BUNDLE_BYTES = 8 << 20
# Longer texts are counted and scored in pieces of so many characters.
PIECE_CHARS = 1 << 15
AT_ONCE = 1 << 20
# A block can tell so many characters apart; texts with more between them are several blocks.
ALPHABET = 1 << 16
CODE_POINTS = 0x110000

BUNDLES = pa.schema(
    [("bundle", pa.int64()), ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())),
     ("langs", pa.list_(pa.string())), ("pieces", pa.list_(pa.int32())), ("befores", pa.list_(pa.int32())),
     ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())]
)
BUNDLE_FIELDS = (
    "bundle long, rows array<long>, doc_ids array<long>, hashes array<long>, langs array<string>, pieces array<int>, "
    "befores array<int>, sizes array<int>, texts binary"
)
GRAMS = pa.schema([("bundle", pa.int64()), ("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
SCORES = pa.schema(
    [("row", pa.int64()), ("pieces", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lang", pa.string()),
     ("n_chars", pa.int64()), ("log_prob", pa.float64())]
)
SCORE_FIELDS = "row long, pieces int, doc_id long, text_hash long, lang string, n_chars long, log_prob double"


def _pieces(text: bytes) -> list[tuple[bytes, int]]:
    """A text in pieces, each after the first with the characters before it, and how many these are."""
    if len(text) <= PIECE_CHARS:
        return [(text, 0)]
    text = text.decode(errors="replace")
    starts = range(0, len(text), PIECE_CHARS)
    return [(text[max(0, at - ORDER + 1) : at + PIECE_CHARS].encode(), min(at, ORDER - 1)) for at in starts]


def _packed_bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text_hash, lang, text) as bundles of about BUNDLE_BYTES."""
    # What earlier work left in this worker is not needed here.
    kept_by_worker("nothing", lambda: None)
    task, bundle, row = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []
    size = 0

    def packed():
        *columns, texts = zip(*held)
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        values = [[task << 32 | bundle], *([list(c)] for c in columns), [[len(t) for t in texts]], [blob]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BUNDLES)], schema=BUNDLES)

    for batch in batches:
        for doc_id, text_hash, lang, text in zip(*(batch.column(i) for i in range(4))):
            pieces = _pieces(text.as_buffer().to_pybytes())
            for piece, before in pieces:
                held.append((task << 40 | row, doc_id.as_py(), text_hash.as_py(), lang.as_py(), len(pieces), before, piece))
                size += len(piece)
                if size >= BUNDLE_BYTES:
                    yield packed()
                    held, size, bundle = [], 0, bundle + 1
            row += 1
    if held:
        yield packed()


def bundled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """A written table of bundles, bucketed by bundle, so that joins by bundle leave it in place."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(*row_of(id_col, text_col), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text.alias("text"))
    name = f"cadenza_bundles_{uuid.uuid4().hex}"
    made = rows.mapInArrow(_packed_bundles, BUNDLE_FIELDS)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "bundle").option("path", new_path(spark, "bundles")).saveAsTable(name)
    held = spark.table(name)
    # The files stay, and the plan knows them; the name is not needed any more.
    spark.sql(f"DROP TABLE {name}")
    return held


def _stored(df: DataFrame, label: str) -> DataFrame:
    """A table written to the shared folder in compressed columns, for what is too wide to checkpoint."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


class Block:
    """Texts of one language as one row of characters, each text after its padding.

    The n-gram at place i is the one that begins there. Those of a text, one per character, begin at
    `first` of the text; the ORDER - 1 after them reach into the next padding and count for nothing.
    A piece of a longer text has the characters before it for padding.
    """

    def __init__(self, texts: list[str], befores: list[int] | None = None):
        befores = befores or [0] * len(texts)
        self.sizes = np.array([len(t) - n for t, n in zip(texts, befores)], dtype=np.int64)
        self.spans = self.sizes + ORDER - 1
        self.first = np.cumsum(self.spans) - self.spans
        self.end = int(self.spans.sum()) - ORDER + 1
        self.known = np.zeros(CODE_POINTS, dtype=bool)
        for points in self._points(texts, befores):
            self.known[points] = True
        self.alphabet = np.flatnonzero(self.known).astype("<u4")
        if len(self.alphabet) > ALPHABET:
            raise ValueError("too many characters for a block")
        self.place = np.zeros(CODE_POINTS, dtype=np.uint16)
        self.place[self.alphabet] = np.arange(len(self.alphabet))
        self.codes = np.concatenate([self.place[points] for points in self._points(texts, befores)])

    @staticmethod
    def _points(texts: list[str], befores: list[int]) -> Iterator[np.ndarray]:
        """The code points of all texts with their padding, some texts at a time."""
        held, size = [], 0
        for text, n in zip(texts, befores):
            held.append(PAD * (ORDER - 1 - n) + text)
            size += len(text)
            if size > AT_ONCE:
                yield np.frombuffer("".join(held).encode("utf-32-le"), dtype="<u4")
                held, size = [], 0
        yield np.frombuffer("".join(held).encode("utf-32-le"), dtype="<u4")

    def keys(self, start: int, end: int) -> np.ndarray:
        key = np.zeros(end - start, dtype=np.uint64)
        for i in range(ORDER):
            key = key << np.uint64(16) | self.codes[start + i : end + i]
        return key

    def stretches(self) -> Iterator[tuple[int, int, slice]]:
        """Spans of places, with the texts that begin in or reach into each."""
        for at in range(0, self.end, AT_ONCE):
            end = min(at + AT_ONCE, self.end)
            yield at, end, slice(int(np.searchsorted(self.first, at, "right")) - 1, int(np.searchsorted(self.first, end)))

    def real(self, start: int, end: int, texts: slice) -> np.ndarray:
        """Whether an n-gram of a text begins at each place."""
        mark = np.ones(end - start, dtype=bool)
        gaps = ((self.first + self.sizes)[texts][:, None] + np.arange(ORDER - 1)).ravel() - start
        mark[gaps[(gaps >= 0) & (gaps < end - start)]] = False
        return mark

    def counted(self, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams that occur, and how often in trusted texts."""
        found, parts, counts = np.zeros(0, np.uint64), [], []
        for start, end, texts in self.stretches():
            keys, real = self.keys(start, end), self.real(start, end, texts)
            found = np.union1d(found, keys[real])
            ends = np.minimum((self.first + self.spans)[texts], end)
            marked = np.repeat(trusted[texts], ends - np.maximum(self.first[texts], start))
            key, n = np.unique(keys[real & marked], return_counts=True)
            parts.append(key)
            counts.append(n)
        total = np.zeros(len(found), dtype=np.int64)
        for key, n in zip(parts, counts):
            total[np.searchsorted(found, key)] += n
        return found, total

    def written(self, keys: np.ndarray) -> list[str]:
        """N-grams as strings."""
        shifts = np.arange(16 * (ORDER - 1), -1, -16, dtype=np.uint64)
        codes = (keys[:, None] >> shifts & np.uint64(0xFFFF)).astype(np.int64)
        text = self.alphabet[codes].tobytes().decode("utf-32-le")
        return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]

    def read(self, grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given n-grams could be here, and the keys of these."""
        points = np.frombuffer("".join(grams).encode("utf-32-le"), dtype="<u4").reshape(-1, ORDER)
        able = self.known[points].all(axis=1)
        key = np.zeros(int(able.sum()), dtype=np.uint64)
        for i in range(ORDER):
            key = key << np.uint64(16) | self.place[points[able, i]]
        return able, key

    def sums(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum over each text of the values of its n-grams; keys are sorted and complete."""
        total = np.zeros(len(self.sizes))
        for start, end, texts in self.stretches():
            found = values[np.searchsorted(keys, self.keys(start, end)) % max(1, len(keys))]
            found[~self.real(start, end, texts)] = 0.0
            total[texts] += np.add.reduceat(found, np.maximum(self.first[texts] - start, 0))
        return total


def _blocks(langs: list[str], sizes: list[int], befores: list[int], blob: bytes) -> Iterator[tuple[str, list[int], Block]]:
    """For each language of a bundle, the places of its texts and the texts as a block, or as several
    where they have too many different characters for one."""
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, sum(sizes))))
    ends = np.cumsum(sizes)
    by_lang = defaultdict(list)
    for i, lang in enumerate(langs):
        by_lang[lang].append(i)
    for lang, places in sorted(by_lang.items()):
        held, texts, chars = [], [], {PAD}
        for i in places:
            text = str(data[ends[i] - sizes[i] : ends[i]], "utf-8", "replace")
            own = {*text}
            if held and len(chars | own) > ALPHABET:
                yield lang, held, Block(texts, [befores[j] for j in held])
                held, texts, chars = [], [], {PAD}
            held.append(i)
            texts.append(text)
            chars |= own
        yield lang, held, Block(texts, [befores[j] for j in held])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bundle, lang, gram, n of the n-grams of each bundle; n counts those in trusted documents."""
    for batch in batches:
        for bundle, langs, sizes, befores, blob, trusted in zip(*(batch.column(i) for i in range(6))):
            langs, bundle = langs.as_py(), bundle.as_py()
            chosen = np.zeros(len(langs), dtype=bool)
            chosen[trusted.as_py() or []] = True
            for lang, places, block in _blocks(langs, sizes.as_py(), befores.as_py(), blob.as_buffer()):
                keys, n = block.counted(chosen[places])
                for at in range(0, len(keys), 50_000):
                    grams = block.written(keys[at : at + 50_000])
                    columns = [[bundle] * len(grams), [lang] * len(grams), grams, n[at : at + 50_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, GRAMS)], schema=GRAMS)


def _score(bundles: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of the pieces of one bundle from the probabilities of all its n-grams."""
    rows = []
    lang = answers.column("lang")
    for at in range(bundles.num_rows):
        held = {name: bundles.column(name)[at] for name in BUNDLES.names}
        facts = {name: held[name].as_py() for name in BUNDLES.names if name != "texts"}
        for name, places, block in _blocks(facts["langs"], facts["sizes"], facts["befores"], held["texts"].as_buffer()):
            mine = answers.filter(pc.equal(lang, name))
            able, keys = block.read(mine.column("gram").to_pylist())
            order = np.argsort(keys)
            sums = block.sums(keys[order], mine.column("log_p").to_numpy()[able][order]) if len(keys) else np.zeros(len(places))
            rows += [
                (facts["rows"][i], facts["pieces"][i], facts["doc_ids"][i], facts["hashes"][i], name, int(n), float(v))
                for i, n, v in zip(places, block.sizes, sums)
            ]
    columns = list(zip(*rows)) or [[]] * len(SCORES)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, SCORES)], schema=SCORES)


def _suffix(gram: str, n: int) -> Column:
    return F.expr(f"right({gram}, {n})")


def continuation_counts(counts: DataFrame, order: int) -> dict[int, DataFrame]:
    """lang, gram, n by order: occurrences at the highest, numbers of different left neighbours below."""
    found = {order: counts}
    for n in range(order - 1, 0, -1):
        found[n] = cut(found[n + 1].groupBy("lang", _suffix("gram", n).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    return found


def discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: what is taken from n-grams seen once, twice and more often, from how many
    there are of each in the language."""
    times = [F.count(F.when(F.col("n") == i, 1)).alias(f"t{i}") for i in range(1, 5)]
    t1, t2, t3, t4 = (F.col(f"t{i}") for i in range(1, 5))
    y = F.try_divide(t1, t1 + 2 * t2)
    second = 2 - 3 * y * F.try_divide(t3, t2)
    raw = [1 - 2 * y * F.try_divide(t2, t1), second, F.coalesce(3 - 4 * y * F.try_divide(t4, t3), second)]
    known = (t1 > 0) & (t2 > 0)
    limited = [F.when(known, F.least(F.greatest(d, F.lit(0.1)), F.lit(float(i)))).otherwise(0.5) for i, d in enumerate(raw, 1)]
    return counts.groupBy("lang").agg(*times).select("lang", *[d.alias(f"d{i}") for i, d in enumerate(limited, 1)])


def probabilities(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, p for every asked n-gram; counts (lang, gram, n) are those of trusted texts.

    p(w | h) = max(c(hw) - D, 0) / c(h) + b(h) p(w | h without its first character), where b(h) is
    what the discounts D took from the continuations of h. After an unseen h the shorter one decides.
    Below single characters stands an even share for every character known in any language.
    """
    by_order = continuation_counts(counts, order)
    wanted = {order: asked}
    for n in range(order - 1, 0, -1):
        wanted[n] = cut(wanted[n + 1].select("lang", _suffix("gram", n).alias("gram")).distinct())
    even = 1.0 / (by_order[1].select("gram").distinct().count() + 1)
    shorter = None
    for n in range(1, order + 1):
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = join_small(by_order[n], cut(discounts(by_order[n])), ["lang"], ["gram"], missing=False)
        seen = seen.select("lang", "gram", "n", taken.alias("less_own"))
        context = F.expr(f"left(gram, {n - 1})").alias("context")
        contexts = seen.groupBy("lang", context).agg(F.sum("n").alias("all"), F.sum("less_own").alias("taken"))
        rows = wanted[n].select("lang", "gram", context).join(seen, ["lang", "gram"], "left")
        rows = rows.join(contexts, ["lang", "context"], "left")
        if shorter is None:
            rows = rows.withColumn("less", F.lit(even))
        else:
            tails = shorter.select("lang", F.col("gram").alias("tail"), F.col("p").alias("less"))
            rows = rows.withColumn("tail", _suffix("gram", n - 1)).join(tails, ["lang", "tail"])
        own = F.coalesce(F.greatest(F.col("n") - F.col("less_own"), F.lit(0.0)) / F.col("all"), F.lit(0.0))
        rest = F.coalesce(F.col("taken") / F.col("all"), F.lit(1.0))
        shorter = cut(rows.select("lang", "gram", (own + rest * F.col("less")).alias("p")))
    return shorter


def perplexities(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, text_hash, lang, n_chars, log_prob of every document under a model of the trusted ones.

    trusted has the doc_id of each trusted document. A missing language is "".
    """
    bundles = bundled(docs, id_col, text_col, lang_col)
    named = trusted.select(F.col("doc_id").alias("__id")).filter("__id IS NOT NULL").distinct()
    places = bundles.select("bundle", F.posexplode("doc_ids").alias("place", "doc_id"))
    chosen = places.join(named, F.col("doc_id") == F.col("__id"))
    listed = chosen.groupBy("bundle").agg(F.collect_list("place").alias("trusted"))
    texts = bundles.select("bundle", "langs", "sizes", "befores", "texts").join(listed.hint("shuffle_hash"), "bundle", "left")
    grams = _stored(texts.mapInArrow(_count, "bundle long, lang string, gram string, n long"), "grams")
    totals = cut(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    known = probabilities(totals.filter("n > 0"), totals.select("lang", "gram"))
    answers = grams.select("bundle", "lang", "gram").join(known, ["lang", "gram"]).select(
        "bundle", "lang", "gram", F.ln("p").cast("float").alias("log_p")
    )
    scored = cut(bundles.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(_score, SCORE_FIELDS))
    names = ["doc_id", "text_hash", "lang"]
    sums = [F.sum(c).alias(c) for c in ("n_chars", "log_prob")]
    many = scored.filter("pieces > 1").groupBy("row", *names).agg(*sums)
    return scored.filter("pieces = 1").select(*names, "n_chars", "log_prob").union(many.select(*names, "n_chars", "log_prob"))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    share: float = 0.995,
    slack: float = 1.0,
    long: int = 400,
    folds: int = 5,
) -> DataFrame:
    """doc_id, text_hash, lang, n_chars, perplexity, threshold, kept of every document.

    One in `folds` trusted documents is left out of the model and sets the thresholds, since those
    the model has seen score better than others. The logarithm of the perplexity may exceed the
    median of the left-out documents of the language by the `share` quantile of what theirs does
    (times `slack`). As short texts scatter more, the excess is measured in units of one over the root
    of the length, up to `long` characters.
    """
    left_out = F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == 0
    scored = perplexities(docs, trusted.filter(~left_out), id_col, text_col, lang_col)
    scored = scored.withColumn("level", F.when(F.col("n_chars") > 0, -F.col("log_prob") / F.col("n_chars")))
    root = F.sqrt(F.least(F.col("n_chars"), F.lit(long)).cast("double"))
    marks = trusted.filter(left_out).select(F.col("doc_id").alias("__id")).distinct()
    judged = scored.filter("level IS NOT NULL").join(marks, F.col("doc_id") == F.col("__id"), "left_semi")
    middles = cut(judged.groupBy("lang").agg(F.percentile_approx("level", 0.5, 100_000).alias("middle")))
    above = join_small(judged, middles, ["lang"], ["doc_id"]).withColumn("excess", (F.col("level") - F.col("middle")) * root)
    most = above.groupBy("lang").agg(F.percentile_approx("excess", share, 100_000).alias("excess"))
    limits = cut(middles.join(most, "lang").select("lang", "middle", (slack * F.greatest("excess", F.lit(0.0))).alias("most")))
    met = join_small(scored, limits, ["lang"], ["doc_id", "text_hash"])
    limit = F.exp(F.col("middle") + F.col("most") / root)
    met = met.withColumn("perplexity", F.exp("level")).withColumn("threshold", F.when(F.col("n_chars") > 0, limit))
    kept = F.col("level").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return met.select("doc_id", "text_hash", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))


def keep_fluent(docs: DataFrame, trusted: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", **limits) -> DataFrame:
    """docs without the rejected ones, columns as they were."""
    judged = judge(docs, trusted, id_col, text_col, lang_col, **limits)
    out = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    row_id, row_hash = row_of(id_col, text_col)
    marked = docs.withColumn("__row_hash", row_hash)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row_hash") == F.col("__hash"))
    return marked.join(out, same, "left_anti").drop("__row_hash")


send_with_tasks(__name__)
