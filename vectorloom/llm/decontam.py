"""Benchmark decontamination: rare word seeds that stand close together, then Smith-Waterman alignment.

Words are lower-cased runs of ASCII letters and digits and non-ASCII characters. A pass
over all documents counts in how many each word of the items occurs. A score of
``min_score`` needs ``least`` = ceil(min_score x size) of an item's words to match, in a
passage of at most (3 - 2 min_score) x size words; so of the item's size - least + c
rarest words, c at least match there, whatever was changed, left out or put in between.
These are the item's seeds: a second pass looks in each document for c seeds of an item
within a passage's length and aligns the words around them with the item (Smith-Waterman,
word by word). No pair from ``min_score`` up is missed, and an item's most frequent words
are never looked up. Items are a stated query set: they are met with all documents in
blocks of bounded size, each broadcast, so no document is shuffled and a document that
many items hit costs time, not memory.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MATCH, MISMATCH, GAP = 2, -1, -1
MAX_HITS = 1 << 20         # seeds met at a time, or those of one document


class Items:
    """A block of benchmark items as word hashes, with their seeds in hash order."""

    def __init__(self, ids: list, texts: list[str], n: int, min_score: float) -> None:
        self.ids = ids
        buf, offs = T.text_bytes(pa.array(texts, pa.string()))
        words, owner, _ = words_of(T.Hasher(), buf, offs)
        cut = T.bounds(owner, len(ids))
        self.words = [words[cut[i]:cut[i + 1]] for i in range(len(ids))]
        self.size = np.diff(cut)
        self.score = np.where(self.size < n, 1.0, min_score)       # a shorter item counts as a whole
        self.least = np.maximum(1, np.ceil(self.score * self.size - 1e-9).astype(np.int64))
        self.together = np.maximum(1, self.least // 4)
        self.reach = np.maximum(self.size, np.floor((3 - 2 * self.score) * self.size + 1e-9).astype(np.int64))
        self.seed(np.unique(words), np.zeros(0, np.int64))

        self.distinct = [np.unique(w, return_counts=True) for w in self.words]

    def in_common(self, i: int, passage: np.ndarray) -> int:
        """How many of the item's words the passage has, in any order."""
        words, most = self.distinct[i]
        at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
        return int(np.minimum(np.bincount(at[words[at] == passage], minlength=len(words)), most).sum())

    def seed(self, hashes: np.ndarray, item: np.ndarray) -> None:
        self.hash, self.item = hashes, item

    def keep_rarest(self, spread: dict[int, int]) -> None:
        """Keeps each item's rarest words, so many that any passage of its score has ``together`` of them."""
        hashes, item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(self.words):
            df = np.asarray([spread.get(h, 0) for h in w.view(np.int64).tolist()], np.int64)
            most = len(w) - int(self.least[i]) + int(self.together[i])
            rare = np.lexsort((w, df))[:most]
            own = np.unique(w[rare[df[rare] > 0]])         # a word of no document counts, but hits nothing
            if self.least[i] <= (df > 0).sum():
                hashes.append(own)
                item.append(np.full(len(own), i))
        every, items = np.concatenate(hashes), np.concatenate(item)
        order = np.lexsort((items, every))
        self.seed(every[order], items[order])

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of words that are seeds, and each one's range of seeds (first, end)."""
        lo = np.searchsorted(self.hash, words, side="left")
        at = np.flatnonzero(self.hash[np.minimum(lo, len(self.hash) - 1)] == words) if len(self.hash) else lo[:0]
        return at, lo[at], np.searchsorted(self.hash, words[at], side="right")

    def passages(self, words: np.ndarray, owner: np.ndarray, n_docs: int) -> Iterator[tuple[int, int, int, int]]:
        """doc, item, first word, end: every passage that can reach the item's score is within one."""
        at, lo, hi = self.hits(words)
        many = np.concatenate([[0], np.cumsum(hi - lo)])
        cut = T.bounds(owner, n_docs)
        edge = many[T.bounds(owner[at], n_docs)]           # hits before each document
        first = 0
        while first < n_docs:
            end = max(first + 1, int(np.searchsorted(edge, edge[first] + MAX_HITS, side="right")) - 1)
            a, z = np.searchsorted(at, [cut[first], cut[end]])
            yield from self._together(owner, cut, at[a:z], lo[a:z], hi[a:z])
            first = end

    def _together(self, owner, cut, at, lo, hi) -> Iterator[tuple[int, int, int, int]]:
        n = hi - lo
        place = np.repeat(at, n)
        item = self.item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        key = owner[place] * len(self.ids) + item
        order = np.argsort(key, kind="stable")             # by document, item, place
        key, item, place = key[order], item[order], place[order]
        last = np.arange(len(key)) + self.together[item] - 1
        k = np.flatnonzero(last < len(key))
        k = k[(key[last[k]] == key[k]) & (place[last[k]] - place[k] < self.reach[item[k]])]
        doc, item = owner[place[k]], item[k]
        begin = np.maximum(cut[doc], place[last[k]] - self.reach[item] + 1)
        end = np.minimum(cut[doc + 1], place[k] + self.reach[item])
        # passages of one document and item that overlap become one; begin and end ascend within a key
        new = np.ones(len(k), dtype=bool)
        new[1:] = (key[k][1:] != key[k][:-1]) | (begin[1:] > end[:-1])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(k))[:len(start)] - 1
        yield from zip(doc[start].tolist(), item[start].tolist(), begin[start].tolist(), end[stop].tolist())


def words_of(hasher: T.Hasher, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, text index and start byte of all words."""
    low = T.LOWER[buf]
    starts, ends, owner = T.runs(T.ALNUM[low], offs)
    return (hasher.spans(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)), owner, starts


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """The Smith-Waterman score of the best local alignment of two word sequences."""
    m = len(passage)
    if not m or not len(item):
        return 0
    # rows of score + row + column - in these sums gaps cost nothing - a few at a time
    rows, best = max(1, (1 << 20) // m), 0
    least = np.arange(m + 1)                     # the sum at score 0
    prev = least.copy()
    for k in range(0, len(item), rows):
        block = np.empty((len(item[k:k + rows]), m + 1), np.int64)
        block[:, 0] = np.arange(k + 1, k + 1 + len(block))
        block[:, 1:] = np.where(item[k:k + rows, None] == passage, MATCH - 2 * GAP, MISMATCH - 2 * GAP)
        for cur in block:
            least += 1
            row = cur[1:]
            row += prev[:-1]
            np.maximum(row, prev[1:], out=row)
            np.maximum(row, least[1:], out=row)
            np.maximum.accumulate(row, out=row)
            prev = cur
        best = max(best, int((block - block[:, :1] - np.arange(m + 1)).max()))
    return best


def item_blocks(items: DataFrame, n: int, min_score: float, id_col: str, text_col: str,
                block_chars: int) -> Iterator[Items]:
    """The items in blocks of at most ``block_chars`` characters (or one item), by id."""
    ids, texts, size = [], [], 0
    for row in items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        text = row[1] or ""
        if ids and size + len(text) > block_chars:
            yield Items(ids, texts, n, min_score)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(text)
        size += len(text)
    if ids:
        yield Items(ids, texts, n, min_score)


def _spread(docs: DataFrame, block: Items, text_col: str) -> dict[int, int]:
    """In how many documents each word of the block occurs; at most a row per word."""
    shared = T.share(docs.sparkSession, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = shared(), T.Hasher()
        total = np.zeros(len(own.hash) + 1, np.int64)
        for b in batches:
            for _, _, part, offs in T.chunks(*T.text_bytes(b.column(0))):
                words, owner, _ = words_of(hasher, part, offs)
                at, lo, _ = own.hits(words)
                pairs = np.unique(owner[at] * len(total) + lo)
                total += np.bincount(pairs % len(total), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.hash[used].view(np.int64)), pa.array(total[used])],
                                         names=["seed", "n"])

    rows = docs.select(text_col).mapInArrow(T.kernel(run), "seed bigint, n bigint").groupBy("seed").sum("n").collect()
    return dict(map(tuple, rows))


def overlaps(docs: DataFrame, items: DataFrame, n: int = 4, min_score: float = 0.5,
             id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
             item_text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, score: the documents' best alignment with each item, from ``min_score`` up.

    score is the Smith-Waterman score over the item's own (1: the whole item, word for
    word). Every pair of at least ``min_score`` is found, so a document that repeats an item
    as a whole or in an edited form from about 0.5. Items of fewer than ``n`` words count
    only as a whole. Null or empty texts on either side, and texts
    without words, overlap with nothing. Repeated rows give repeated results. Without
    documents or items the result is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    types = (rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString())
    schema = f"doc_id {types[0]}, item_id {types[1]}, score double"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items, n, min_score, item_id_col, item_text_col, block_chars):
        if len(block.hash):
            block.keep_rarest(_spread(rows, block, "text"))
            out = out.union(rows.mapInArrow(T.kernel(_aligner(spark, block, items.schema[item_id_col])), schema))
    return out


def _aligner(spark, block: Items, id_field):
    shared = T.share(spark, block)       # at most block_chars characters
    item_type = to_arrow_type(id_field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = shared(), T.Hasher()
        known: dict[tuple, float] = {}
        for b in batches:
            docs, found, scores = [], [], []
            for lo_doc, hi_doc, part, offs in T.chunks(*T.text_bytes(b.column(1))):
                words, owner, _ = words_of(hasher, part, offs)
                best: dict[tuple[int, int], float] = {}
                for doc, i, first, end in own.passages(words, owner, hi_doc - lo_doc):
                    passage = words[first:end]
                    if own.in_common(i, passage) < own.least[i]:
                        continue
                    key = (i, passage.tobytes())
                    if (score := known.get(key)) is None:
                        score = align(own.words[i], passage) / (MATCH * len(own.words[i]))
                        if len(known) < 20_000:
                            known[key] = score
                    best[doc, i] = max(best.get((doc, i), 0.0), score)
                for (doc, i), score in best.items():
                    if score >= own.score[i]:
                        docs.append(lo_doc + doc)
                        found.append(own.ids[i])
                        scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(docs, pa.int64())), pa.array(found, item_type),
                 pa.array(scores, pa.float64())], names=["doc_id", "item_id", "score"])

    return run


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those that overlap an item; all columns stay.

    Rows that share an id with a contaminated row go with it; rows with a null id stay.
    """
    found = overlaps(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(found, F.col(f"`{id_col}`") == F.col("__hit"), "left_anti")
