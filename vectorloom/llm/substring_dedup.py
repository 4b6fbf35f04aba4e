"""Repeated passages, found by content-defined chunking.

A gear rolling hash over the UTF-8 bytes cuts a text where its low ``bits`` bits are 0;
these depend on the last ``bits`` bytes alone, so cuts move with the content and an
insertion disturbs only the chunks around it. Chunks have ``least`` to ``most`` bytes.
A chunk whose 128-bit digest stands earlier (lesser document, then lesser offset) is a
repeat, and adjoining repeats of at least ``min_bytes`` bytes are a repeated passage.
Digests are pre-aggregated per task; only the chunks that a fixed-size Bloom filter of
the repeated digests lets through are shuffled again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import tokens as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GEAR = (T.mix(np.arange(256, dtype=np.uint64) + np.uint64(77)) & np.uint64(0xFFFF)).astype(np.uint16)
BLOOM_BITS = 26


def cuts(buf: np.ndarray, offs: np.ndarray, bits: int = 5, least: int = 16, most: int = 512
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of all chunks; ``least`` must not be under ``bits``."""
    rolled = np.zeros(len(buf), np.uint16)
    gear = GEAR[buf]
    for j in range(bits):
        rolled[j:] += gear[:len(buf) - j] << np.uint16(j)
    at = np.flatnonzero((rolled & np.uint16((1 << bits) - 1)) == 0) + 1
    lo = np.searchsorted(at, offs[:-1], side="right")
    hi = np.searchsorted(at, offs[1:], side="left")
    starts, ends, owner = [], [], []
    places = at.tolist()
    for i in range(len(offs) - 1):
        prev, end = int(offs[i]), int(offs[i + 1])
        if prev == end:
            continue
        first = len(starts)
        for c in places[lo[i]:hi[i]]:
            if c - prev >= least:
                while c - prev > most:
                    starts.append(prev)
                    ends.append(prev + most)
                    prev += most
                if c > prev:
                    starts.append(prev)
                    ends.append(c)
                    prev = c
        while end - prev > most:
            starts.append(prev)
            ends.append(prev + most)
            prev += most
        if end > prev:
            starts.append(prev)
            ends.append(end)
        owner.append(np.full(len(starts) - first, i))
    z = np.zeros(0, np.int64)
    return np.asarray(starts, np.int64), np.asarray(ends, np.int64), np.concatenate(owner) if owner else z


def chunks(docs: DataFrame, repeated: np.ndarray | None = None, **options) -> DataFrame:
    """doc, at, until (byte offsets), h, g (digest) of all chunks, or of those in the Bloom filter."""
    share = T.share(docs.sparkSession, repeated)
    id_type = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, wanted = T.Hasher(1000), T.Hasher(5000), share()
        for b in batches:
            for lo, _, part, offs in T.chunks(*T.text_bytes(b.column(1))):
                starts, ends, owner = cuts(part, offs, **options)
                h, g = one.spans(part, starts, ends), two.spans(part, starts, ends)
                if wanted is not None:
                    bit = h >> np.uint64(64 - BLOOM_BITS)
                    keep = np.flatnonzero(wanted[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    starts, ends, owner, h, g = (x[keep] for x in (starts, ends, owner, h, g))
                base = offs[owner]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(owner + lo)), pa.array(starts - base), pa.array(ends - base),
                     pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=["doc", "at", "until", "h", "g"])

    return docs.mapInArrow(run, f"doc {id_type}, at bigint, until bigint, h bigint, g bigint")


def _bloom(digests: DataFrame) -> np.ndarray:
    """A bit per hash bucket that holds a repeated digest: 8 MB, built from one row per used word."""
    bucket = F.shiftrightunsigned("h", 64 - BLOOM_BITS)
    words = (digests.groupBy(F.shiftright(bucket, 5).alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BLOOM_BITS}) & 31 as int))")).alias("b"))
             .toArrow())
    out = np.zeros((1 << BLOOM_BITS) // 32, "<u4")
    out[words.column("word").to_numpy()] = words.column("b").to_numpy().astype("<u4")
    return out.view(np.uint8)


def repeated_passages(docs: DataFrame, min_bytes: int = 64, **options) -> DataFrame:
    """doc, spans: array of (start, end) byte ranges that repeat earlier passages.

    ``docs`` has ``doc``, of any type with an order, and ``text``.
    """
    everywhere = chunks(docs, **options)
    first = (everywhere.groupBy("h", "g").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    first = cut_lineage(first, "digests")
    again = chunks(docs, _bloom(first), **options).join(first, ["h", "g"]).filter(
        F.struct("doc", "at") != F.col("first"))
    per_doc = again.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("at", "until"))).alias("c"))
    per_doc = per_doc.select("doc", F.col("c.at").alias("a"), F.col("c.until").alias("b"))
    id_type = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, spans = [], []
            for i in range(b.num_rows):
                a, z = b.column(1)[i].values.to_numpy(), b.column(2)[i].values.to_numpy()
                new = np.append(True, a[1:] != z[:-1])
                start, end = a[new], z[np.append(new[1:], True)]
                found = [{"start": int(x), "end": int(y)} for x, y in zip(start, end) if y - x >= min_bytes]
                if found:
                    keep.append(i)
                    spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(spans, kind)],
                                             names=["doc", "spans"])

    return per_doc.mapInArrow(run, f"doc {id_type}, spans array<struct<start:bigint,end:bigint>>")


def _key(id_col: str, text_col: str):
    return F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: the id, n_bytes, repeated_bytes and spans (empty if nothing repeats).

    Documents stand in the order of ids (null first) and, where ids repeat, of a hash of
    the text; rows equal in both are one document. Null and empty texts have no bytes.
    """
    key = _key(id_col, text_col)
    found = repeated_passages(docs.select(key.alias("doc"), F.col(f"`{text_col}`").alias("text")), **options)
    rows = docs.select(F.col(f"`{id_col}`").alias("__i"), key.getField("h").alias("__h"),
                       F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint").alias("n_bytes"))
    found = found.select(F.col("doc.id").alias("i"), F.col("doc.h").alias("h"), "spans")
    out = rows.join(found, F.col("__i").eqNullSafe(F.col("i")) & (F.col("__h") == F.col("h")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return out.select(F.col("__i").alias(id_col), "n_bytes",
                      F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"]).alias("repeated_bytes"),
                      spans.alias("spans"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without their later repeats, all other columns as they were.

    Cuts fall between bytes; a span's ends are moved inwards to whole characters. See
    ``passage_report`` for null, empty and repeated rows.
    """
    key = _key(id_col, text_col)
    found = repeated_passages(docs.select(key.alias("doc"), F.col(f"`{text_col}`").alias("text")), **options)
    found = found.select(F.col("doc.id").alias("__i"), F.col("doc.h").alias("__h"), F.col("spans").alias("__spans"))
    joined = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("__i"))
                       & (key.getField("h") == F.col("__h")), "left").drop("__i", "__h")
    names, at = docs.columns, docs.columns.index(text_col)

    def strip(text: str, spans: list[dict]) -> str:
        raw, out, done = text.encode(), [], 0
        for s in spans:
            start, end = s["start"], s["end"]
            while start < end and raw[start] & 0xC0 == 0x80:
                start += 1
            while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append(raw[done:start])
            done = end
        return b"".join([*out, raw[done:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not s else strip(t, s)
                     for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())]
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, schema)
