"""Packing of tokenised documents into fixed windows by best-fit decreasing.

``cut_documents`` tokenises each whole text once and cuts it into full windows
and one remainder. ``pack`` places the pieces: the corpus-wide histogram of
piece lengths has at most ``size`` entries whatever the corpus, so best-fit
decreasing runs on counts. Windows with the same remaining capacity are
interchangeable; a segment tree over the capacities finds the tightest open one,
and each step places a whole run of equal pieces. The plan says where the r-th
piece of each length goes; Spark ranks the pieces of a length in salted buckets
and looks their places up. No piece passes through the driver.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import tokens as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPECIAL = "<|endoftext|>"
CACHE_WORDS = 200_000


def _bytes(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class ByteBpe:
    """Ids of the byte-level BPE, as little-endian unsigned 32-bit bytes.

    A cut before a space that follows a non-space character is always a cut
    between pre-tokens, so a text without other white-space runs is the
    sequence of its space-led words, and a word's ids can be kept. The special
    token's string stands for its id, as in the JSON tokenizer.
    """

    def __init__(self, ranks_path: str, pattern: str, special_id: int) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={SPECIAL: special_id})
        self._words: dict[str, bytes] = {}
        self._odd = re.compile(r"\s ")

    def _encode(self, text: str) -> bytes:
        return _bytes(self._bpe.encode(text, allowed_special="all"))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text or self._odd.search(text):
            return self._encode(text)
        words = text.split(" ")
        known = self._words
        if len(known) > CACHE_WORDS:
            known.clear()
        out = list(map(known.get, words[1:]))
        if None in out:
            plain = self._bpe.encode_ordinary         # the special token's text is in no word here
            for i, found in enumerate(out):
                if found is None:
                    w = words[i + 1]
                    if (got := known.get(w)) is None:
                        got = known[w] = _bytes(plain(" " + w))
                    out[i] = got
        return self._encode(words[0]) + b"".join(out)


def cut_documents(docs: DataFrame, size: int = 2048, vocabulary: str = "byte_bpe_50k",
                  end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens.

    A document is its ids followed by ``end_id``; every ``size`` ids make a full
    piece and the rest is the last piece. A null or empty text is ``end_id``
    alone. Repeated rows are packed each on its own; other columns are ignored.
    """
    special_id = 50256
    id_type = docs.schema[id_col].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        # the path is looked up where the file is read
        bpe = ByteBpe(public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN, special_id)
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = bpe.ids(text.as_py() or "") + end
                total, step = len(ids) // 4, 4 * size
                for at in range(0, len(ids), step):
                    part = ids[at:at + step]
                    rows.append(i)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(total)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())),
                 *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], names=names)

    schema = f"doc_id {id_type.simpleString()}, " + ", ".join(f"{c} bigint" for c in names[1:])
    return docs.select(id_col, text_col).mapInArrow(T.kernel(run), schema)


class CapacityTree:
    """A segment tree over capacities 0..size: which of them have open windows."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least open capacity of at least ``length``."""
        i = length + self.leaves
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Steps (length, first rank, first window, offset) that place every piece.

    Pieces of a length with ranks from the step's first rank on go to
    consecutive windows from its first window on, all at the same offset, up to
    the next step of that length.
    """
    tree, ranges = CapacityTree(size), [[] for _ in range(size + 1)]
    steps: list[tuple[int, int, int, int]] = []
    windows = 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            ranges[capacity].append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = size, -(-left // (size // length))
                put(room, windows, n)
                windows += n
            first, n = ranges[room].pop()
            if not ranges[room]:
                tree.set(room, False)
            fit = room // length
            filled = min(n, left // fit)
            times = fit
            if not filled:              # the last few pieces share one window
                filled, times = 1, left
            for k in range(times):
                steps.append((length, rank, first, size - room + k * length))
                rank += filled
            put(room - times * length, first, filled)
            put(room, first + filled, n - filled)
            left -= filled * times
    return steps


def pack(pieces: DataFrame, size: int = 2048, bucket_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to the pieces; no window holds over ``size`` ids.

    An empty table gives an empty result. Equal pieces are ranked by doc_id,
    start and checksum; full ties are the same row, so their order does not matter.
    """
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces, "pieces")     # tokenised once; ranks see fixed rows
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}   # at most `size` rows
    steps = sorted(best_fit_decreasing(counts, size))
    shift = 48
    keys = np.asarray([(s[0] << shift) + s[1] for s in steps], dtype=np.int64)
    ranks = np.asarray([s[1] for s in steps], dtype=np.int64)
    firsts = np.asarray([s[2] for s in steps], dtype=np.int64)
    offsets = np.asarray([s[3] for s in steps], dtype=np.int64)
    plan = spark.sparkContext.broadcast((keys, ranks, firsts, offsets))   # bounded by size, not by rows

    buckets = max(16, sum(counts.values()) // bucket_rows)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (dealt.groupBy("length", "bucket").count()
            .withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (dealt.withColumn("nth", F.row_number().over(within) - 1)
              .join(base, ["length", "bucket"])
              .select(*pieces.columns, (F.col("base") + F.col("nth")).alias("rank")))
    at = ranked.columns.index("length"), ranked.columns.index("rank")
    kept = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, firsts, offsets = plan.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in at)
            step = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(kept))),
                 pa.array(firsts[step] + rank - ranks[step]), pa.array(offsets[step])],
                names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(T.kernel(place), f"{schema}, sequence_id bigint, offset bigint")
