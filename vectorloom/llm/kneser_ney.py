"""Quality filter: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over whole characters (A-Z lower-cased). It is trained on all trusted labelled
documents by sharded count joins: the n-grams of the highest order are counted per chunk of
text and summed by n-gram, each lower order's continuation counts come from the order above
by grouping, and an order's probabilities from its counts joined to its contexts and to the
order below. Discounts follow the counts of counts (D1, D2, D3+). Below the single
characters stands a model over 48 byte classes, which spells a character that trusted text
does not have byte by byte: a dense table of at most 48^order entries whatever the corpus.

Scoring meets the distinct n-grams of the documents with the tables of probabilities. Tables of
at most ``HELD_GRAMS`` n-grams are broadcast and looked up chunk by chunk, so that no n-gram of the
documents is shuffled; larger ones are joined to the documents' counted n-grams. Texts are not
shuffled while the ids of the trusted ones can be broadcast. A document is kept when its
perplexity per character is at most its language's quantile among all trusted documents.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.joins import bounded_rows, broadcast_if_bounded
from ..session import cut_lineage
from . import tokens as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = 48
PUNCTUATION = b".,!?'\"-|%&$#"
_classes = np.full(256, 31 + len(PUNCTUATION), np.int64)       # any other ASCII byte
_classes[np.arange(0x61, 0x7B)] = np.arange(1, 27)
_classes[0x20], _classes[0x0A] = 27, 28
_classes[0x30:0x3A] = 29
for _i, _c in enumerate(PUNCTUATION):
    _classes[_c] = 30 + _i
_classes[0x80:] = 32 + len(PUNCTUATION) + np.arange(128) % (SYMBOLS - 32 - len(PUNCTUATION))
CLASS = _classes
CLASS_SIZE = np.maximum(np.bincount(CLASS[np.unique(T.LOWER)], minlength=SYMBOLS), 1)      # bytes of each class

PAD = 0xFFFFFFFF                # stands before a text; no character has this number
HELD_GRAMS = 1 << 22            # n-grams of a model that every task holds, 16 bytes each
LEAST = 1e-12                   # of a probability and of what a context spares


def codes(buf: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as a number; each text begins after order - 1 zeros."""
    pad = order - 1
    sizes = np.diff(offs)
    at = np.arange(len(buf)) + np.repeat(np.arange(len(sizes)) + 1, sizes) * pad
    padded = np.zeros(len(buf) + pad * len(sizes), np.int64)
    padded[at] = CLASS[T.LOWER[buf]]
    out = np.zeros(len(buf), np.int64)
    for k in range(order):
        out = out * SYMBOLS + padded[at - pad + k]
    return out, sizes


def count_ngrams(texts: DataFrame, order: int, text_col: str = "text") -> DataFrame:
    """gram, n over all texts, summed per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** order, np.int64)
        for b in batches:
            for _, _, part, offs in T.chunks(*T.text_bytes(b.column(0))):
                grams, n = np.unique(codes(part, offs, order)[0], return_counts=True)
                total[grams] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["gram", "n"])

    return (texts.select(text_col).mapInArrow(run, "gram bigint, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the counts."""
    return discounts_of([int((n == k).sum()) for k in (1, 2, 3, 4)])


def discounts_of(counts: list[int]) -> np.ndarray:
    """The same from how many n-grams have the counts 1 to 4."""
    c = [max(1, k) for k in counts]
    y = c[0] / (c[0] + 2 * c[1])
    d = [0.0, 1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]]
    return np.clip(d, 0.0, [0.0, 1.0, 2.0, 3.0])


def log_probabilities(levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log p(last symbol | the symbols before) for every n-gram of the highest order.

    levels: per order from 1 on, the seen n-grams and their (continuation) counts.
    """
    p = np.full(1, 1 / SYMBOLS)          # order 0: any symbol
    for k, (grams, n) in enumerate(levels):
        d = discounts(n)[np.minimum(n, 3)]
        context = grams // SYMBOLS
        total = np.bincount(context, weights=n, minlength=SYMBOLS ** k)
        spare = np.bincount(context, weights=d, minlength=SYMBOLS ** k)
        share = np.divide(spare, total, out=np.ones(len(spare)), where=total > 0)
        new = np.repeat(share, SYMBOLS) * np.tile(p, SYMBOLS)       # p of the n-gram's suffix
        new[grams] += (n - d) / total[context]
        p = new
    return np.log(np.maximum(p, LEAST)).astype(np.float32)


def train(texts: DataFrame, order: int = 4, text_col: str = "text") -> np.ndarray:
    """The dense table of log probabilities of byte classes in the trusted texts; uniform without any."""
    counts = cut_lineage(count_ngrams(texts, order, text_col), "ngrams")
    tables = [counts]
    for k in range(order - 1, 0, -1):
        # how many different symbols stand before the suffix
        tables.append(tables[-1].groupBy((F.col("gram") % SYMBOLS ** k).alias("gram")).agg(F.count("*").alias("n")))
    levels = []
    for t in reversed(tables):
        rows = t.toArrow()                       # at most 48^order rows
        levels.append((rows.column("gram").to_numpy(), rows.column("n").to_numpy()))
    return log_probabilities(levels)


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each text, as the number of their UTF-8 bytes (the first lowest), and the texts' offsets."""
    low, n = T.LOWER[buf], len(buf)
    first = (low & 0xC0) != 0x80
    if first.all():
        return low.astype(np.uint32), offs
    first[offs[:-1][offs[:-1] < n]] = True
    place = np.arange(n)
    first |= (place - np.maximum.accumulate(np.where(first, place, 0))) % 4 == 0      # of bytes that are no UTF-8
    at = np.flatnonzero(first)
    sizes = np.diff(at, append=n)
    out = low[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = sizes > k
        out[more] |= low[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, np.searchsorted(at, offs)


def placed(symbols: np.ndarray, offs: np.ndarray, order: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols with order - 1 pads before each text, and where each symbol stands."""
    sizes = np.diff(offs)
    at = np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)) + 1, sizes) * (order - 1)
    padded = np.full(len(symbols) + (order - 1) * len(sizes), pad, symbols.dtype)
    padded[at] = symbols
    return padded, at


def numbered(padded: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """A number for the n-gram that ends at each place; equal ones have the same."""
    _, ids = np.unique(padded, return_inverse=True)
    base = int(ids.max(initial=0)) + 1
    out = ids[at - order + 1]
    for k in range(order - 2, -1, -1):
        if (int(out.max(initial=0)) + 1) * base >= 1 << 62:
            _, out = np.unique(out, return_inverse=True)
        out = out * base + ids[at - k]
    return out


def _grams(padded: np.ndarray, at: np.ndarray, order: int) -> pa.Array:
    """The n-grams that end at the given places, four bytes a symbol."""
    symbols = np.stack([padded[at - k] for k in range(order - 1, -1, -1)], axis=1).astype("<u4")
    cuts = np.arange(len(at) + 1, dtype=np.int32) * (4 * order)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(symbols.tobytes())])


def count_characters(texts: DataFrame, order: int, text_col: str = "text") -> DataFrame:
    """gram, n over all texts, counted per chunk and task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, part, offs in T.chunks(*T.text_bytes(b.column(0))):
                padded, at = placed(*characters(part, offs), order, PAD)
                _, first, n = np.unique(numbered(padded, at, order), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_grams(padded, at[first], order), pa.array(n)], names=["gram", "n"])

    return (texts.select(text_col).mapInArrow(T.kernel(run), "gram binary, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def speller(spark: SparkSession, table: np.ndarray, order: int) -> Callable[[np.ndarray], np.ndarray]:
    """Log probabilities of characters by the table of byte classes, each at the beginning of a text."""
    share = T.share(spark, table)
    held: list[np.ndarray] = []

    def spell(symbols: np.ndarray) -> np.ndarray:
        held or held.append(share())
        sizes = 1 + sum((symbols >> np.uint32(8 * k) > 0).astype(np.int64) for k in (1, 2, 3))
        buf = symbols.astype("<u4").view("u1").reshape(-1, 4)[np.arange(4) < sizes[:, None]]
        offs = np.concatenate([[0], np.cumsum(sizes)])
        logs = held[0][codes(buf, offs, order)[0]] - np.log(CLASS_SIZE[CLASS[T.LOWER[buf]]])
        return np.add.reduceat(logs, offs[:-1], dtype=np.float64) if len(symbols) else np.zeros(0)

    return spell


def train_characters(texts: DataFrame, order: int, spell: Callable[[np.ndarray], np.ndarray],
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(gram, log p) of the seen n-grams of every order, and (context, log share) of their contexts.

    A gram's length tells its order, a context's is one symbol less. An n-gram that is not seen has the
    probability of its suffix times the share of its context, where that is seen.
    """
    levels = {order: cut_lineage(count_characters(texts, order, text_col), "characters")}
    for k in range(order - 1, 0, -1):
        # how many different characters stand before the suffix
        levels[k] = cut_lineage(levels[k + 1].groupBy(F.substring("gram", 5, 4 * k).alias("gram"))
                                .agg(F.count("*").alias("n")), "characters")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            symbols = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.exp(spell(symbols)))], names=["lower", "below"])

    probabilities, shares = [], []
    for k in range(1, order + 1):
        of = levels[k].agg(*(F.coalesce(F.sum((F.col("n") == c).cast("int")), F.lit(0)) for c in (1, 2, 3, 4))).first()
        d = [float(x) for x in discounts_of(list(of))]
        rows = levels[k].select(
            "gram", F.substring("gram", 1, 4 * (k - 1)).alias("context"), "n",
            F.substring("gram", 5, 4 * (k - 1)).alias("lower"),
            F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3]).alias("d"))
        contexts = cut_lineage(rows.groupBy("context").agg(
            F.sum("n").alias("total"), F.greatest(F.sum("d") / F.sum("n"), F.lit(LEAST)).alias("share")), "contexts")
        if k == 1:
            below = levels[1].select("gram").mapInArrow(T.kernel(spelled), "lower binary, below double")
            rows = rows.withColumn("lower", F.col("gram"))
        else:
            below = probabilities[-1].select(F.col("gram").alias("lower"), F.col("p").alias("below"))
        probabilities.append(cut_lineage(rows.join(contexts, "context").join(below, "lower").select(
            "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("share") * F.col("below")).alias("p")),
            "probabilities"))
        shares.append(contexts.select("context", F.log("share").alias("share")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))     # noqa: E731
    return union(probabilities).select("gram", F.log(F.greatest("p", F.lit(LEAST))).alias("p")), union(shares)


def _by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per number of symbols: the n-grams, one a row, and their values."""
    grams, values = rows.column(0).combine_chunks(), rows.column(1).to_numpy()
    sizes = pc.binary_length(grams).to_numpy(zero_copy_only=False) // 4
    return {int(k): (np.frombuffer(b"".join(grams.filter(pa.array(sizes == k)).to_pylist()), "<u4").reshape(-1, k)
                     if k else np.zeros((1, 0), np.uint32), values[sizes == k]) for k in np.unique(sizes)}


class Held:
    """A model whose n-grams fit into a number: sorted numbers of the n-grams and contexts, with their values."""

    def __init__(self, grams: pa.Table, shares: pa.Table, order: int) -> None:
        seen, spared = _by_length(grams), _by_length(shares)
        self.order = order
        self.known = np.sort(seen[1][0][:, 0]) if 1 in seen else np.zeros(0, np.uint32)
        self.base = len(self.known) + 2         # a pad is 0, a character that is not known the last
        self.fits = self.base ** order < 1 << 62
        if self.fits:
            self.seen = {k: self.sorted(*v) for k, v in seen.items()}
            self.spared = {k: self.sorted(*v) for k, v in spared.items()}

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.where(symbols == PAD, 0, 1)
        at = np.minimum(np.searchsorted(self.known, symbols), len(self.known) - 1)
        return np.where(symbols == PAD, 0, np.where(self.known[at] == symbols, at + 1, self.base - 1))

    def sorted(self, grams: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.zeros(len(grams), np.int64)
        for column in grams.T:
            number = number * self.base + self.ids(column)
        order = np.argsort(number)
        return number[order], values[order]

    @staticmethod
    def found(table: tuple[np.ndarray, np.ndarray] | None, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table is None:
            return np.zeros(len(numbers), bool), np.zeros(len(numbers))
        at = np.minimum(np.searchsorted(table[0], numbers), len(table[0]) - 1)
        return table[0][at] == numbers, table[1][at]

    def logs(self, symbols: np.ndarray, offs: np.ndarray, spell: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The log probability of each character."""
        padded, at = placed(self.ids(symbols), offs, self.order, 0)
        number = np.zeros(len(at), np.int64)
        for k in range(self.order - 1, -1, -1):
            number = number * self.base + padded[at - k]
        grams, which = np.unique(number, return_inverse=True)
        value, left = np.zeros(len(grams)), np.ones(len(grams), bool)
        for k in range(self.order, 0, -1):
            hit, p = self.found(self.seen.get(k), grams % self.base ** k)
            value[left & hit] += p[left & hit]
            left &= ~hit
            hit, share = self.found(self.spared.get(k - 1), grams // self.base % self.base ** (k - 1))
            value[left & hit] += share[left & hit]
        out = value[which]
        new = np.flatnonzero(padded[at] == self.base - 1)
        chars, one = np.unique(symbols[new], return_inverse=True)
        out[new] += spell(chars)[one]
        return out


def _held_perplexities(docs: DataFrame, model: Held, spell: Callable[[np.ndarray], np.ndarray],
                       text_col: str) -> DataFrame:
    share = T.share(docs.sparkSession, model)
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = share()
        for b in batches:
            parts = [np.zeros(0)]
            for _, _, part, offs in T.chunks(*T.text_bytes(b.column(len(names)))):
                symbols, at = characters(part, offs)
                sums = np.concatenate([[0.0], np.cumsum(held.logs(symbols, at, spell))])
                sizes = np.diff(at)
                mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(sizes, 1)
                parts.append(np.where(sizes > 0, np.exp(-mean), np.nan))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names))), pa.array(np.concatenate(parts), from_pandas=True)],
                names=[*names, "perplexity"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, text_col).mapInArrow(T.kernel(run), f"{schema}, perplexity double")


def _joined_perplexities(docs: DataFrame, grams: DataFrame, shares: DataFrame, order: int,
                         spell: Callable[[np.ndarray], np.ndarray], text_col: str) -> DataFrame:
    """The same by joins of the documents' counted n-grams with the tables of any size."""
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part, offs in T.chunks(*T.text_bytes(b.column(len(names)))):
                symbols, cuts = characters(part, offs)
                padded, at = placed(symbols, cuts, order, PAD)
                owner = np.repeat(np.arange(hi - lo), np.diff(cuts))
                _, number = np.unique(numbered(padded, at, order), return_inverse=True)
                _, first, n = np.unique(owner * (int(number.max(initial=0)) + 1) + number, return_index=True,
                                        return_counts=True)
                chars, one = np.unique(symbols[first], return_inverse=True)
                lists = pa.array(T.bounds(owner[first], hi - lo), pa.int32())
                found = [_grams(padded, at[first], order), pa.array(n), pa.array(spell(chars)[one])]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in range(len(names))), pa.array(np.diff(cuts)),
                     *(pa.ListArray.from_arrays(lists, x) for x in found)], names=[*names, "size", "gram", "n", "spelled"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    counted = cut_lineage(
        docs.select(*names, text_col).mapInArrow(T.kernel(run), f"{schema}, size bigint, gram array<binary>, "
                                                 "n array<bigint>, spelled array<double>")
        .withColumn("uid", F.monotonically_increasing_id()), "counted")
    rows = counted.select("uid", F.explode(F.arrays_zip("gram", "n", "spelled")).alias("g")).select("uid", "g.*")
    value = rows.groupBy("gram").agg(F.first("spelled").alias("spelled")).withColumn("value", F.col("spelled"))
    for k in range(1, order + 1):            # from the shortest suffix on, as each order rests on the one below
        value = (value.withColumn("suffix", F.substring("gram", 1 + 4 * (order - k), 4 * k))
                 .withColumn("context", F.substring("gram", 1 + 4 * (order - k), 4 * (k - 1)))
                 .join(grams.select(F.col("gram").alias("suffix"), "p"), "suffix", "left")
                 .join(shares, "context", "left")
                 .select("gram", F.coalesce("p", F.col("value") + F.coalesce("share", F.lit(0.0))).alias("value")))
    sums = rows.join(value, "gram").groupBy("uid").agg(F.sum(F.col("n") * F.col("value")).alias("sum"))
    return counted.select("uid", "size", *names).join(sums, "uid", "left").select(
        *names, F.when(F.col("size") > 0, F.exp(-F.col("sum") / F.col("size"))).alias("perplexity"))


def perplexities(docs: DataFrame, grams: DataFrame, shares: DataFrame, order: int,
                 spell: Callable[[np.ndarray], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs (the text last) without the text, with perplexity per character (null for null and empty texts)."""
    if bounded_rows(grams, HELD_GRAMS) is not None:
        model = Held(grams.toArrow(), shares.toArrow(), order)         # at most HELD_GRAMS rows, and fewer contexts
        if model.fits:
            return _held_perplexities(docs, model, spell, text_col)
    return _joined_perplexities(docs, grams, shares, order, spell, text_col)


def classify(docs: DataFrame, labels: DataFrame, order: int = 4, sample_docs: int | None = None,
             quantile: float = 0.995, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per document: the id, the language, perplexity, threshold and kept.

    Trusted are labelled rows with quality 1 that are not marked toxic. They train the model:
    all, or about ``sample_docs`` of them, picked by a hash of the id. The quantiles are
    over all (of each language with trusted documents; others, and a null language,
    use the quantile of all). Every document is scored and judged. Null and empty texts have
    no perplexity and are not kept. Without trusted documents nothing has a threshold and
    all texts are kept. Repeated rows are judged each on its own.
    """
    trusted = (labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("__t"))
               .filter("__t is not null").distinct())
    # ids, sent to the texts where they are proven to fit
    trusted, _ = broadcast_if_bounded(trusted, 40 if isinstance(trusted.schema["__t"].dataType, IntegralType) else 160)
    learned = trusted
    if sample_docs is not None:
        part = int(min(1.0, sample_docs / max(1, trusted.count())) * (1 << 30))
        learned = trusted.filter(F.pmod(F.xxhash64("__t"), F.lit(1 << 30)) < part)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{lang_col}`").alias(lang_col),
                       F.col(f"`{text_col}`").alias("text"))
    known = rows.join(learned, F.col(id_col) == F.col("__t"), "left_semi")
    spell = speller(docs.sparkSession, train(known, order), order)
    grams, shares = train_characters(known, order, spell)
    scored = cut_lineage(perplexities(rows, grams, shares, order, spell), "perplexities")
    good = (scored.filter("perplexity is not null")            # ids and numbers, no texts
            .join(trusted, F.col(id_col) == F.col("__t"), "left_semi"))
    at = F.percentile_approx("perplexity", quantile, 10_000)
    per_language = good.groupBy(F.col(lang_col).alias("__l")).agg(at.alias("own"))
    overall = good.agg(at).first()[0]
    # one row per language
    limit = F.coalesce("own", F.lit(overall).cast("double"))
    return (scored.join(F.broadcast(per_language), F.col(lang_col) == F.col("__l"), "left")
            .select(id_col, lang_col, "perplexity", limit.alias("threshold"),
                    (F.col("perplexity").isNotNull()
                     & F.coalesce(F.col("perplexity") <= limit, F.lit(True))).alias("kept")))
