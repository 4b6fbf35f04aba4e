"""Arrow-batch numpy kernels run by ``mapInArrow``.

These are the only places where Python touches rows, and only where the work is
a dense matrix product: scoring a bounded, broadcast block of query vectors
against the rows of a partition, multiplying rows by a broadcast D x D matrix,
nearest-centroid search, and per-partition Gram matrices. Spark partitions,
shuffles and merges the results; the kernels never see more than one batch plus
a bounded running state.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, LongType, StringType, StructField, StructType

from ..functions.joins import bounded_rows

# Ship this module's kernels to Python workers by value, so executors need
# only numpy and pyarrow, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_ID = np.iinfo(np.int64).max
SCORE_DIGITS = 9
HALF_DIGIT = 0.6 * 10.0 ** -SCORE_DIGITS        # what rounding may add to a score, and a little more
# working-set budget of one block of distances (rows x centroids x 8 bytes)
BLOCK_BYTES = 64 * 1024 * 1024
# queries and rows of one product of scores, and the pairs of one batch where all are given
PRODUCT_QUERIES, PRODUCT_ROWS = 512, 2560
# vectors up to this length are multiplied in single precision; one pair in so many is scored again
# in double, so many pairs at a time
SINGLE_LENGTH, FEW, GATHERED = 1e15, 16, 1 << 13
PAIRS = 1 << 20


def _matrix(arr, d: int) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    vals = arr.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(vals, dtype=np.float64).reshape(-1, d)


def _list_array(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1), type=pa.float64()))


def collect_block(df: DataFrame, key: str, vec: str, d: int,
                  max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bring a block of at most ``max_rows`` vectors to the driver (checked)."""
    n = bounded_rows(df, max_rows)
    if n is None:
        raise ValueError(f"block exceeds {max_rows} rows; split it first")
    t = df.select(F.col(key).cast("bigint").alias("k"),
                  F.col(vec).cast("array<double>").alias("v")).toArrow()
    keys = t.column("k").to_numpy()
    mat = _matrix(t.column("v"), d) if n else np.zeros((0, d))
    return keys, mat


# --------------------------------------------------------------------------
# top-K scoring
# --------------------------------------------------------------------------

class _Best:
    """The running top-k of the queries ``qm`` (one vector a row), by score and then id.

    Queries are taken a few at a time against a few rows, so that a product's scores stay in a
    core's cache. Products are made in single precision; what may reach the k-th best of its query
    so far, by a bound of their error, is scored again in double. These are merged with the held
    ones when they are as many, so the state is about 2 k entries a query.
    """

    def __init__(self, qm: np.ndarray, k: int) -> None:
        self.parts = [_BestPart(qm[lo:lo + PRODUCT_QUERIES], k) for lo in range(0, len(qm), PRODUCT_QUERIES)]

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        for lo in range(0, len(x), PRODUCT_ROWS):
            some = x[lo:lo + PRODUCT_ROWS]
            longest = _longest(some)
            single = some.astype(np.float32) if longest < SINGLE_LENGTH else None
            for part in self.parts:
                part.add(some, ids[lo:lo + PRODUCT_ROWS], single, longest)

    def rows(self, qids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(qid, id, score) of all held."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, part in enumerate(self.parts):
            part.merge()
            q, ids, scores = part.held
            if len(q):
                out.append((q + i * PRODUCT_QUERIES, ids, scores))
        q, ids, scores = (np.concatenate(c) for c in zip(*(out[1:] or out)))
        return qids[q], ids, scores


def _longest(x: np.ndarray) -> float:
    """The greatest length of a row; infinite or no number where a component is."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0)))


def _few_places(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask that holds few, found eight at a time."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    eights = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    of, place = np.nonzero(mask.reshape(-1, 8)[eights])
    return eights[of] * 8 + place


class _BestPart:
    def __init__(self, qm: np.ndarray, k: int) -> None:
        self.qm, self.k = qm, k
        self.held: tuple = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
        self.new: list[tuple] = []
        self.waiting = 0
        self.kth = np.full(len(qm), -np.inf)        # the k-th best score of each query, and its id
        self.last: np.ndarray | None = None
        longest = _longest(qm)
        self.single = qm.astype(np.float32) if longest < SINGLE_LENGTH else None
        # of a product in single precision: d roundings of sums, two of components, one of a product
        self.error = (qm.shape[1] + 4) * 2.0 ** -24 * longest

    def scored(self, x: np.ndarray, ids: np.ndarray, single: np.ndarray | None, longest: float) -> tuple | None:
        """(query, row, score) of the pairs that may be among the best; None where these are not few."""
        if single is None or self.single is None:
            return None
        floor = (self.kth - HALF_DIGIT - 1.01 * self.error * longest).astype(np.float32)
        at = _few_places(self.single @ single.T >= np.nextafter(floor, np.float32(-np.inf))[:, None])
        if len(at) * FEW > len(self.qm) * len(x):
            return None
        q, c = np.divmod(at, len(x))
        scores = np.zeros(len(at))
        for lo in range(0, len(at), GATHERED):
            some = slice(lo, lo + GATHERED)
            np.einsum("ij,ij->i", self.qm[q[some]], x[c[some]], out=scores[some])
        return q, c, scores

    def add(self, x: np.ndarray, ids: np.ndarray, single: np.ndarray | None = None, longest: float = np.inf) -> None:
        n = len(ids)
        few = self.scored(x, ids, single, longest) if np.isfinite(self.kth).any() else None
        if few is None:
            s = self.qm @ x.T
            keep = ~(s < (self.kth - HALF_DIGIT)[:, None])          # what is no number counts as the lowest
            if n > 2 * self.k and np.count_nonzero(keep) * 4 > keep.size:
                top = np.partition(s, n - self.k, axis=1)[:, n - self.k:]
                if not np.isnan(top).any():
                    keep &= s >= (top[:, 0] - 2 * HALF_DIGIT)[:, None]
            q, c = np.divmod(np.flatnonzero(keep), n)
            few = q, c, s[q, c]
        q, c, scores = few
        if not len(q):
            return
        scores, ids = np.round(scores, SCORE_DIGITS), ids[c]
        kept = ~(scores < self.kth[q])
        if self.last is not None:
            tied = np.flatnonzero(scores == self.kth[q])
            kept[tied[np.asarray(ids[tied] > self.last[q[tied]], dtype=bool)]] = False
        q, ids, scores = q[kept].astype(np.int32), ids[kept], scores[kept]
        self.new.append((q, ids, scores))
        self.waiting += len(q)
        if self.waiting > max(self.k * len(self.qm), 1 << 14):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        parts = [self.held, *self.new] if len(self.held[0]) else self.new
        q, ids, scores = (np.concatenate(c) for c in zip(*parts))
        named = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        o = np.lexsort((named, -scores, q))
        q = q[o]
        first = np.searchsorted(q, np.arange(len(self.qm)))
        place = np.arange(len(q)) - first[q]
        o, q, place = o[place < self.k], q[place < self.k], place[place < self.k]
        self.held = q, ids[o], scores[o]
        full = np.flatnonzero(place == self.k - 1)
        if self.last is None:
            self.last = np.full(len(self.qm), None if ids.dtype == object else MAX_ID, dtype=ids.dtype)
        self.kth[q[full]], self.last[q[full]] = self.held[2][full], self.held[1][full]
        self.new, self.waiting = [], 0


def tile_topk(k: int | None, d: int, qtype: str, rtype: str):
    """Rows (g, b, lane, side, qid, docid, v) sorted by these to (g, qid, docid, score).

    A tile is what shares (g, b, lane): first its queries (side 0), which are held, then its
    rows, which stream past them. With ``k`` a tile gives each query's exact top-k at its end,
    else every pair.
    """
    arrow = {"bigint": pa.int64(), "string": pa.string()}

    def batch(g, qids, ids, scores):
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(g, pa.string()), len(scores)), pa.array(qids, arrow[qtype]),
             pa.array(ids, arrow[rtype]), pa.array(scores, pa.float64())], names=["g", "qid", "docid", "score"])

    def held(g, best, qids):
        qids, ids, scores = best.rows(qids)
        for lo in range(0, len(qids), PAIRS):
            yield batch(g, qids[lo:lo + PAIRS], ids[lo:lo + PAIRS], scores[lo:lo + PAIRS])

    def run(batches):
        tile, qids, parts, qm, best = None, None, [], None, None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            g = rb.column(0)
            at = [g.dictionary_encode().indices, *(rb.column(i) for i in (1, 2, 3))]
            at = np.stack([c.to_numpy(zero_copy_only=False) for c in at])
            ends = [*(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1), rb.num_rows]
            start = 0
            for end in ends:
                here = (g[start].as_py(), *at[1:3, start].tolist())
                if here != tile:
                    if best is not None:
                        yield from held(tile[0], best, qids)
                    tile, parts, qm, best = here, [], None, None
                part = rb.slice(start, end - start)
                start = end
                x = _matrix(part.column(6), d)
                if at[3, end - 1] == 0:
                    parts.append((part.column(4).to_numpy(zero_copy_only=False), x))
                    continue
                if not parts:                       # rows of a block that no query fell into
                    continue
                if qm is None:
                    qids, qm = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    parts = [(qids, qm)]
                    best = None if k is None else _Best(qm, k)
                ids = part.column(5).to_numpy(zero_copy_only=False)
                if best is not None:
                    best.add(x, ids)
                    continue
                chunk = max(1, PAIRS // len(qids))
                for lo in range(0, len(ids), chunk):
                    some = ids[lo:lo + chunk]
                    s = np.round(qm @ x[lo:lo + chunk].T, SCORE_DIGITS)
                    yield batch(tile[0], np.repeat(qids, len(some)), np.tile(some, len(qids)), s.reshape(-1))
        if best is not None:
            yield from held(tile[0], best, qids)
    return run


def _topk_fn(bq, k: int, d: int, id_col: str, vec_col: str, types: tuple[pa.DataType, pa.DataType]):
    def run(batches):
        qids, qm = bq.value
        best = _Best(qm, k)
        for rb in batches:
            if rb.num_rows:
                best.add(_matrix(rb.column(vec_col), d), rb.column(id_col).to_numpy(zero_copy_only=False))
        q, ids, scores = best.rows(qids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, types[0]), pa.array(ids, types[1]), pa.array(scores, pa.float64())],
            names=["qid", "docid", "score"])
    return run


def key_type(df: DataFrame, col: str) -> str:
    """The type an id column is ranked in: bigint for whole numbers, else string."""
    return "bigint" if isinstance(df.schema[col].dataType, IntegralType) else "string"


def score_block(rows: DataFrame, qids: np.ndarray, qmat: np.ndarray, k: int, d: int, id_col: str = "docid",
                vec_col: str = "embedding") -> DataFrame:
    """(qid, docid, score) of one broadcast query block against a stream of rows.

    Each partition emits only its exact local top-k per query (ties by docid), so the
    output is bounded by queries x k x partitions. Rows without id or vector are left out.
    """
    bq = rows.sparkSession.sparkContext.broadcast((qids, qmat.astype(np.float64)))
    rtype = key_type(rows, id_col)
    qtype = "string" if qids.dtype == object else "bigint"
    src = rows.select(F.col(id_col).cast(rtype).alias(id_col),
                      F.col(vec_col).cast("array<double>").alias(vec_col)) \
              .where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
    arrow = {"bigint": pa.int64(), "string": pa.string()}
    return src.mapInArrow(_topk_fn(bq, k, d, id_col, vec_col, (arrow[qtype], arrow[rtype])),
                          f"qid {qtype}, docid {rtype}, score double")


# --------------------------------------------------------------------------
# pooling words
# --------------------------------------------------------------------------

# words whose vectors are gathered at once, few enough for a core's cache
POOLED_WORDS = 1 << 12
# texts of one output batch
POOLED_TEXTS = 2000
# coded words that are decoded for one output batch
DECODED_WORDS = 1 << 16


class Coded:
    """Vectors as the codes of their weights: ``scale * levels[code]``, decoded when rows are taken."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, levels: np.ndarray) -> None:
        self.codes, self.scale, self.levels, self.shape = codes, scale, levels, codes.shape

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return self.levels[self.codes[rows]] * self.scale[rows, None]


def word_rows(words: pa.Array, lex: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(at, row): the place in ``lex`` and the number of its list for every word that ``lex`` has."""
    at = pc.index_in(words.flatten(), value_set=lex)
    known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    at = at.drop_null().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return at, np.repeat(np.arange(len(words)), sizes)[known]


def row_sums(at: np.ndarray, row: np.ndarray, lists: int, vectors: np.ndarray | Coded,
             counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, n) per list of ``word_rows``; without ``counts`` every word has one vector."""
    sums, n = np.zeros((lists, vectors.shape[1])), np.zeros(lists, dtype=np.int64)
    if isinstance(vectors, Coded):          # each word that occurs is decoded once, where they are few
        seen = np.zeros(len(vectors.codes), dtype=bool)
        seen[at] = True
        used = np.flatnonzero(seen)
        if len(used) <= DECODED_WORDS:
            place = np.zeros(len(seen), dtype=np.int32)
            place[used] = np.arange(len(used), dtype=np.int32)
            at, vectors = place[at], vectors[used]
            counts = None if counts is None else counts[used]
    for lo in range(0, len(at), POOLED_WORDS):
        some, of = at[lo:lo + POOLED_WORDS], row[lo:lo + POOLED_WORDS]
        first = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
        sums[of[first]] += np.add.reduceat(np.asarray(vectors[some], dtype=np.float64), first, axis=0)
        n[of[first]] += np.diff(first, append=len(of)) if counts is None else np.add.reduceat(counts[some], first)
    return sums, n


def word_sums(words: pa.Array, lex: pa.Array, vectors: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, n) of the lists of words of a batch: the vectors of the words that ``lex`` has
    added up per list, and how many these are. ``vectors`` has one row per word of ``lex``, the
    sum of the ``counts`` vectors that the word has."""
    return row_sums(*word_rows(words, lex), len(words), vectors, counts)


def held_lexicon(rows: pa.Table, d: int, last: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, vectors, counts) for ``word_sums`` of a table (word, embedding); vectors narrower
    than ``d`` are filled up with zeros, null ones left out. A word that is there more often has
    the sum of its vectors, or its ``last``."""
    rows = rows.filter(pc.is_valid(rows.column("embedding")))
    word = rows.column("word").combine_chunks()
    lex = pc.unique(word)
    at = pc.index_in(word, value_set=lex).to_numpy(zero_copy_only=False)
    vectors, counts = np.zeros((len(lex), d)), np.bincount(at, minlength=len(lex)).astype(np.int64)
    for column in rows.column("embedding").chunks:
        own = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(len(column), -1)
        if last:
            vectors[at[:len(column)], :own.shape[1]] = own
        else:
            np.add.at(vectors[:, :own.shape[1]], at[:len(column)], own)
        at = at[len(column):]
    return lex, vectors, np.ones_like(counts) if last else counts


def compact_lexicon(rows: pa.Table, d: int, levels: np.ndarray | None, bits: int | None = None) -> tuple | None:
    """``held_lexicon`` of a table (word, *weights columns) in less memory with the same values: codes
    (packed ones of ``bits``), or single precision that loses nothing. The words are sorted; None
    where a word is there more often, or a vector has nulls or another width."""
    rows = rows.filter(pc.is_valid(rows.column(1)))
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("word", "ascending")]))
    word, column = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
    if not len(word) or len(pc.unique(word)) < len(word):
        return None
    if bits is None:
        values = column.flatten()
        if values.null_count or pc.any(pc.not_equal(pc.list_value_length(column), d)).as_py():
            return None
        values = values.to_numpy(zero_copy_only=False).reshape(-1, d)
    else:
        values = unpacked(column, d, bits)
    if levels is None:
        with np.errstate(over="ignore"):
            single = values.astype(np.float32)
        return word, single if np.array_equal(single, values, equal_nan=True) else values, None
    scale = rows.column(2).combine_chunks()
    if scale.null_count or values.min() < -len(levels) or values.max() >= len(levels):
        return None
    return word, Coded(values, scale.to_numpy(zero_copy_only=False), levels), None


def send_lexicons(spark, lexicons: dict[str, tuple]):
    """A broadcast of ``held_lexicon`` or ``compact_lexicon`` per model for ``pool_words``; words that
    several models share are sent once."""
    tables: list[pa.Array] = []
    parts = {}
    for m, (lex, vectors, counts) in lexicons.items():
        at = next((i for i, other in enumerate(tables) if other.equals(lex)), len(tables))
        tables.extend([lex] if at == len(tables) else [])
        # a broadcast is read without this module: no class of it
        parts[m] = at, (vectors.codes, vectors.scale, vectors.levels) if isinstance(vectors, Coded) else vectors, counts
    return spark.sparkContext.broadcast((tables, parts))


def value_once(sent):
    """The value of a broadcast, which the worker does not keep where it can be read again."""
    value = sent.value
    if getattr(sent, "_path", None) is not None:
        vars(sent).pop("_value", None)
    return value


def lexicons_of(value) -> tuple[list[pa.Array], dict[str, tuple]]:
    """The tables of words, and (table, vectors, counts) of each model, of a value of ``send_lexicons``."""
    tables, models = value
    return tables, {m: (at, Coded(*vectors) if isinstance(vectors, tuple) else vectors, counts)
                    for m, (at, vectors, counts) in models.items()}


def pool_words(texts: DataFrame, held, d: int) -> DataFrame:
    """(model, text_id, embedding, n): the vectors of each text's words added up under every model.

    ``texts`` is (text_id, words array<string>); ``held`` is a broadcast of ``send_lexicons``, of
    bounded size. No word leaves its task.
    """
    def run(batches):
        tables, models = lexicons_of(held.value)
        for rb in batches:
            for lo in range(0, rb.num_rows, POOLED_TEXTS):
                part = rb.slice(lo, POOLED_TEXTS)
                found = [word_rows(part.column(1), lex) for lex in tables]
                for m, (at, vectors, counts) in models.items():
                    sums, n = row_sums(*found[at], part.num_rows, vectors, counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(m, pa.string()), len(n)), part.column(0), _list_array(sums), pa.array(n)],
                        names=["model", "text_id", "embedding", "n"])

    schema = StructType([StructField("model", StringType()), StructField("text_id", texts.schema["text_id"].dataType),
                         StructField("embedding", ArrayType(DoubleType())), StructField("n", LongType())])
    return texts.select("text_id", "words").mapInArrow(run, schema)


# --------------------------------------------------------------------------
# rows @ matrix
# --------------------------------------------------------------------------

def _matmul_fn(bm, keep: list[str], vec_col: str, d: int, out: str):
    def run(batches):
        m = bm.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            y = _matrix(rb.column(vec_col), d) @ m
            cols = [rb.column(c) for c in keep] + [_list_array(y)]
            yield pa.RecordBatch.from_arrays(cols, names=keep + [out])
    return run


def matmul(df: DataFrame, matrix: np.ndarray, vec_col: str = "embedding",
           out: str | None = None) -> DataFrame:
    """Each row vector times a broadcast (D, D') matrix (bounded: D*D' doubles)."""
    out = out or vec_col
    d = matrix.shape[0]
    keep = [c for c in df.columns if c != vec_col]
    spark = df.sparkSession
    bm = spark.sparkContext.broadcast(np.asarray(matrix, dtype=np.float64))
    src = df.select(*keep, F.col(vec_col).cast("array<double>").alias(vec_col))
    fields = [f for f in src.schema.fields if f.name in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ddl = (ddl + ", " if ddl else "") + f"`{out}` array<double>"
    return src.mapInArrow(_matmul_fn(bm, keep, vec_col, d, out), ddl)


def rotate(df: DataFrame, turn: Callable[[np.ndarray], np.ndarray], d: int, vec_col: str = "embedding",
           out: str | None = None) -> DataFrame:
    """Each batch's vectors (rows x D) through ``turn``, a function shipped with its few values."""
    out = out or vec_col
    keep = [c for c in df.columns if c != vec_col]

    def run(batches):
        for rb in batches:
            if rb.num_rows:
                y = turn(_matrix(rb.column(len(keep)), d))
                yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), _list_array(y)], names=[*keep, out])
    src = df.select(*keep, F.col(vec_col).cast("array<double>").alias(vec_col))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{ddl}`{out}` array<double>")


# --------------------------------------------------------------------------
# codes
# --------------------------------------------------------------------------

def unpacked(column: pa.Array, d: int, bits: int) -> np.ndarray:
    """The (rows, D) codes of a binary column of packed rows (layout: ``functions.bits``)."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    if bits not in (1, 2, 4):
        return raw[:, :d]
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * bits          # the first code is in the top bits
    return ((raw[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(len(raw), -1)[:, :d]


def unpack_rows(df: DataFrame, d: int, bits: int, key: str = "row_id", packed: str = "packed") -> DataFrame:
    """(key, codes array<int>) of packed rows."""
    def run(batches):
        for rb in batches:
            if rb.num_rows:
                codes = unpacked(rb.column(1), d, bits).astype(np.int32)
                ends = pa.array(np.arange(0, codes.size + 1, d, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([rb.column(0), pa.ListArray.from_arrays(ends, pa.array(codes.reshape(-1)))],
                                                 names=[key, "codes"])
    return df.select(key, packed).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, codes array<int>")


def decode_rows(df: DataFrame, keep: list[str], d: int, codes: str, bits: int | None = None,
                levels: list[float] | None = None, books: np.ndarray | None = None) -> DataFrame:
    """(*keep, embedding): PQ codes looked up in their broadcast codebooks, or packed codes in the
    levels and scaled. The codebooks never enter the plan."""
    held = df.sparkSession.sparkContext.broadcast(books if books is not None else np.asarray(levels))
    n = len(keep)

    def run(batches):
        values = held.value
        for rb in batches:
            if not rb.num_rows:
                continue
            if bits is None:
                m = values.shape[0]
                at = rb.column(n).flatten().to_numpy(zero_copy_only=False).reshape(-1, m).astype(np.int64)
                x = values[np.arange(m), at].reshape(-1, d)
            else:
                x = values[unpacked(rb.column(n), d, bits)] * np.asarray(rb.column(n + 1))[:, None]
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(n)), _list_array(x)],
                                             names=[*keep, "embedding"])
    src = df.select(*keep, codes, *([] if bits is None else ["scale"]))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:n])
    return src.mapInArrow(run, f"{ddl}embedding array<double>")


# --------------------------------------------------------------------------
# nearest centroid
# --------------------------------------------------------------------------

def nearest(x: np.ndarray, c: np.ndarray, xx: np.ndarray | None = None,
            cc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid (lowest index on ties) and its distance^2."""
    xx = (x * x).sum(1) if xx is None else xx
    cc = (c * c).sum(1) if cc is None else cc
    chunk = max(1, BLOCK_BYTES // (16 * max(1, len(c))))
    if len(x) > chunk:
        parts = [nearest(x[i:i + chunk], c, xx[i:i + chunk], cc) for i in range(0, len(x), chunk)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    dist = np.round(np.maximum(xx[:, None] - 2.0 * (x @ c.T) + cc[None, :], 0.0),
                    SCORE_DIGITS)
    idx = np.argmin(dist, axis=1)
    return idx, dist[np.arange(len(idx)), idx]


def _assign_fn(bc, key: str, vec_col: str, d: int, m: int):
    def run(batches):
        cents = bc.value                    # (m, k, dsub)
        dsub = d // m
        ccs = [(cents[j] * cents[j]).sum(1) for j in range(m)]
        for rb in batches:
            if rb.num_rows == 0:
                continue
            x = _matrix(rb.column(vec_col), d)
            codes = np.empty((len(x), m), dtype=np.int32)
            err = np.zeros(len(x))
            for j in range(m):
                xs = x[:, j * dsub:(j + 1) * dsub]
                codes[:, j], dist = nearest(xs, cents[j], cc=ccs[j])
                err += dist
            offs = pa.array(np.arange(0, (len(x) + 1) * m, m, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [rb.column(key), pa.ListArray.from_arrays(offs, pa.array(codes.reshape(-1))),
                 pa.array(err)], names=[key, "codes", "sq_dist"])
    return run


def assign_codes(df: DataFrame, centroids: np.ndarray, key: str = "row_id",
                 vec_col: str = "embedding") -> DataFrame:
    """(key, codes array<int>, sq_dist) against M broadcast codebooks (M, K, D/M).

    M = 1 is plain k-means assignment.
    """
    m, k, dsub = centroids.shape
    d = m * dsub
    bc = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    src = df.select(F.col(key).cast("bigint").alias(key),
                    F.col(vec_col).cast("array<double>").alias(vec_col))
    return src.mapInArrow(_assign_fn(bc, key, vec_col, d, m),
                          f"{key} bigint, codes array<int>, sq_dist double")


def _fused_fn(bc, vec_col: str, d: int, m: int):
    def run(batches):
        cents = bc.value                    # (m, k, dsub)
        k, dsub = cents.shape[1], d // m
        ccs = [(cents[j] * cents[j]).sum(1) for j in range(m)]
        sums, n, sq = np.zeros(cents.shape), np.zeros((m, k), dtype=np.int64), np.zeros((m, k))
        for rb in batches:
            x = _matrix(rb.column(vec_col), d)
            for j in range(m):
                xs = x[:, j * dsub:(j + 1) * dsub]
                code, dist = nearest(xs, cents[j], cc=ccs[j])
                order = np.argsort(code, kind="stable")
                codes, first = np.unique(code[order], return_index=True)
                if len(codes):
                    sums[j, codes] += np.add.reduceat(xs[order], first, axis=0)
                    n[j] += np.bincount(code, minlength=k)
                    sq[j] += np.bincount(code, weights=dist, minlength=k)
        sub, code = np.nonzero(n)
        if len(sub):
            yield pa.RecordBatch.from_arrays(
                [pa.array(sub.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(n[sub, code]),
                 pa.array(sq[sub, code]), _list_array(sums[sub, code])], names=["sub", "code", "n", "sq", "sums"])
    return run


def assigned_sums(df: DataFrame, centroids: np.ndarray, vec_col: str = "embedding") -> DataFrame:
    """(sub, code, n, sq, sums): every partition's rows, their squared distances and their
    vectors added up per nearest centroid of each of the M broadcast codebooks (M, K, D/M)."""
    m, k, dsub = centroids.shape
    bc = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    src = df.select(F.col(vec_col).cast("array<double>").alias(vec_col))
    return src.mapInArrow(_fused_fn(bc, vec_col, m * dsub, m), "sub int, code int, n bigint, sq double, sums array<double>")


def nearest_distance(df: DataFrame, points: np.ndarray, before: int = 0, key: str = "row_id",
                     vec_col: str = "embedding") -> DataFrame:
    """(key, vector, near, sq_dist): the nearest of the broadcast points (at most a few times k) of each
    row. With ``before``, ``df`` is such a table over that many earlier points, numbered before these."""
    bc = df.sparkSession.sparkContext.broadcast(np.asarray(points, dtype=np.float64))
    d = points.shape[1]

    def run(batches):
        pts = bc.value
        cc = (pts * pts).sum(1)
        for rb in batches:
            if rb.num_rows:
                near, dist = nearest(_matrix(rb.column(1), d), pts, cc=cc)
                near += before
                if before:
                    was = rb.column(3).to_numpy(zero_copy_only=False)
                    near = np.where(dist < was, near, rb.column(2).to_numpy(zero_copy_only=False))
                    dist = np.minimum(dist, was)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0), rb.column(1), pa.array(near.astype(np.int32)), pa.array(dist)],
                    names=[key, vec_col, "near", "sq_dist"])
    src = df.select(F.col(key).cast("bigint").alias(key), F.col(vec_col).cast("array<double>").alias(vec_col),
                    *(["near", "sq_dist"] if before else []))
    return src.mapInArrow(run, f"`{key}` bigint, `{vec_col}` array<double>, near int, sq_dist double")


# --------------------------------------------------------------------------
# Gram partials
# --------------------------------------------------------------------------

def _gram_fn(bmu, vec_col: str, d: int):
    def run(batches):
        mu = bmu.value
        g = np.zeros((d, d))
        n = 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            x = _matrix(rb.column(vec_col), d) - mu
            g += x.T @ x
            n += len(x)
        if n:
            i, j = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.reshape(-1).astype(np.int32)), pa.array(j.reshape(-1).astype(np.int32)),
                 pa.array(g.reshape(-1))], names=["i", "j", "value"])
    return run


def gram_partials(df: DataFrame, mean: np.ndarray, vec_col: str = "embedding") -> DataFrame:
    """(i, j, value) partial sums of (x - mean)(x - mean)^T, one D x D per partition."""
    d = len(mean)
    bmu = df.sparkSession.sparkContext.broadcast(np.asarray(mean, dtype=np.float64))
    src = df.select(F.col(vec_col).cast("array<double>").alias(vec_col))
    return src.mapInArrow(_gram_fn(bmu, vec_col, d), "i int, j int, value double")
