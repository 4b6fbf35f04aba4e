"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Every document is scored by the counts of all the others (its own occurrences are taken
off), so an n-gram that only it has backs off to the shorter one at a cost of ``alpha``.

The relations are exploded n-grams and count tables, both partitioned by the n-gram's
hash. To keep them small, documents are first written in chunks of about a megabyte of
text; a chunk's n-grams are counted before the shuffle and travel as one sorted list per
hash partition. Each partition sums the counts over all chunks and sends every chunk the
totals of its own n-grams, in the same order; a chunk then looks the totals up by
position and sums the scores per document. A frequent n-gram is one entry per chunk, and
no partition's size depends on a single key.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import tokens as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_TEXT = 1 << 20
PARTITION_WORDS = 1 << 20       # words per hash partition, about


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, byte plane by byte plane, so that zstd drops the empty planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").reshape(n)


def chunked(docs: DataFrame) -> DataFrame:
    """chunk, words, data: the documents (id first, then text) in compressed chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi, part, offs in T.chunks(*T.text_bytes(b.column(1)), size=CHUNK_TEXT):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(b.slice(lo, hi - lo))
                words = len(T.runs(~T.SPACE[part], offs)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + number]), pa.array([words]), pa.array([sink.getvalue()], pa.binary())],
                    names=["chunk", "words", "data"])
                number += 1

    return docs.mapInArrow(run, "chunk bigint, words bigint, data binary")


class Chunk:
    """A chunk's words, its n-grams of all orders in hash order, and where each occurs."""

    def __init__(self, data: bytes, order: int, hasher: T.Hasher) -> None:
        self.batch = pa.ipc.open_stream(data).read_all().combine_chunks()
        buf, offs = T.text_bytes(self.batch.column(1))
        low = T.LOWER[buf]
        starts, ends, self.owner = T.runs(~T.SPACE[low], offs)
        words = hasher.spans(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.grams = [T.ngrams(words, self.owner, n) for n in range(1, order + 1)]
        every = np.concatenate([h for h, _ in self.grams])
        self.unique, inverse, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        self.index = np.split(inverse, np.cumsum([len(h) for h, _ in self.grams])[:-1])

    def buckets(self, n: int) -> np.ndarray:
        """n + 1 offsets of the hash partitions in the sorted n-grams."""
        edges = np.asarray([(k << 64) // n for k in range(1, n)], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(self.unique, edges), [len(self.unique)]])


def _sent(chunks: DataFrame, order: int, partitions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.Hasher()
        for b in batches:
            for chunk, data in zip(b.column(0), b.column(1)):
                c = Chunk(data.as_py(), order, hasher)
                cut = c.buckets(partitions)
                used = [k for k in range(partitions) if cut[k + 1] > cut[k]]
                steps = [np.diff(c.unique[cut[k]:cut[k + 1]], prepend=np.uint64(0)) for k in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([chunk.as_py()] * len(used), pa.int64()),
                     pa.array([_pack(s) for s in steps], pa.binary()),
                     pa.array([_pack(c.counts[cut[k]:cut[k + 1]]) for k in used], pa.binary())],
                    names=["bucket", "chunk", "grams", "counts"])

    return chunks.select("chunk", "data").mapInArrow(run, "bucket int, chunk bigint, grams binary, counts binary")


def _total(table: pa.Table) -> pa.Table:
    """Of one hash partition: for each chunk's n-grams, their counts over all chunks."""
    with np.errstate(over="ignore"):
        grams = [np.cumsum(_unpack(g.as_py()), dtype=np.uint64) for g in table.column("grams")]
    counts = [_unpack(c.as_py()).astype(np.int64) for c in table.column("counts")]
    _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)[inverse]
    parts = np.split(totals, np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"),
                     "totals": pa.array([_pack(p) for p in parts], pa.binary())})


def score_documents(docs: DataFrame, order: int = 2, alpha: float = 0.4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row: the id, n_words, log_score (sum of log S over the words) and its mean.

    Words are runs of characters other than space and tab to carriage return; A-Z are
    lower-cased. S of a word after its context is count(context, word) / count(context) in the other
    documents, or alpha times S after the context without its first word; a word no other document has counts
    1 after one more backoff, over the other documents' words. Null and empty texts have
    0 words, score 0 and a null mean. Repeated rows are different documents. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chunks = cut_lineage(chunked(rows), "chunks")
    words = chunks.agg(F.sum("words")).first()[0] or 0
    partitions = max(16, words // PARTITION_WORDS)
    totals = (_sent(chunks, order, partitions).groupBy("bucket")
              .applyInArrow(_total, "bucket int, chunk bigint, totals binary")
              .groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "totals"))).alias("t"))
              .select("chunk", F.col("t.totals").alias("totals")))
    joined = chunks.select("chunk", "data").join(totals, "chunk", "left").select("data", "totals")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.Hasher()
        for b in batches:
            for data, counts in zip(b.column(0), b.column(1)):
                c = Chunk(data.as_py(), order, hasher)
                found = [_unpack(x) for x in counts.as_py() or ()]
                total = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
                yield _scores(c, total, words, order, alpha)

    return joined.mapInArrow(run, f"id {id_type}, n_words bigint, log_score double, mean_log_score double"
                             ).withColumnRenamed("id", id_col)


def _scores(c: Chunk, total: np.ndarray, words: int, order: int, alpha: float) -> pa.RecordBatch:
    n_docs, m = c.batch.num_rows, len(c.owner)
    others = []                                  # per order: counts in the other documents
    for index, (_, at) in zip(c.index, c.grams):
        key = c.owner[at] * max(1, len(c.unique)) + index
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        others.append(total[index] - own[inverse])
    size = np.bincount(c.owner, minlength=n_docs)
    rest = np.maximum(words - size, 1)[c.owner]
    score = np.log(alpha / rest)                 # a word no other document has
    open_ = np.ones(m, dtype=bool)
    position = np.arange(m) - T.bounds(c.owner, n_docs)[c.owner]
    longest = np.minimum(position + 1, order)    # of the n-grams that end at each word
    score += np.log(alpha) * (longest - 1)
    for n in range(order, 0, -1):
        at = c.grams[n - 1][1]                   # first words of the n-grams
        last = at + n - 1
        count = others[n - 1]
        context = rest[last] if n == 1 else others[n - 2][np.searchsorted(c.grams[n - 2][1], at)]
        hit = (count > 0) & open_[last]
        score[last[hit]] = np.log(count[hit] / context[hit]) + np.log(alpha) * (longest[last[hit]] - n)
        open_[last[hit]] = False
    log_score = np.bincount(c.owner, weights=score, minlength=n_docs)
    mean = np.where(size > 0, log_score / np.maximum(size, 1), np.nan)
    return pa.RecordBatch.from_arrays(
        [c.batch.column(0).combine_chunks() if isinstance(c.batch.column(0), pa.ChunkedArray) else c.batch.column(0),
         pa.array(size.astype(np.int64)), pa.array(log_score), pa.array(mean, from_pandas=True)],
        names=["id", "n_words", "log_score", "mean_log_score"])
