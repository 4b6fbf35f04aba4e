"""Byte-level helpers of the text kernels: words, lines and their 64-bit hashes.

Everything works on the UTF-8 bytes of a whole Arrow batch with numpy, a few
megabytes of whole texts at a time, so no Python loop sees single words. Null
texts count as empty. Two hashes of different words collide with a chance of
about 2^-64 per pair.
"""

from __future__ import annotations

import ctypes
import functools
import pickle
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast of a value whose class executors need not have installed."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def give_back() -> None:
    """Return the memory that this worker has freed to the system. Executors keep their Python
    workers, and allocators keep what the largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)            # glibc only
    if trim:
        trim(0)


def kernel(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
           ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches, after which the worker keeps only what it needs."""
    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return task


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


# word separators: space and the control characters tab to carriage return
SPACE = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
# word characters for comparing prose: ASCII letters and digits, and any non-ASCII byte
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B),
                          *range(0x80, 0x100)]))
NEWLINE = byte_class(b"\n")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inv):
        p = np.full(n, np.uint64(b), dtype=np.uint64)
        p[:1] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Hasher:
    """Hashes byte ranges of a buffer; keeps the table of powers between calls."""

    def __init__(self, seed: int = 1000) -> None:
        self._values = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed))
        self._pow = _powers(CHUNK_BYTES + 1)

    def spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(buf)
        if len(self._pow[0]) <= n:
            self._pow = _powers(n + n // 4 + 1)
        p, inv = self._pow
        sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self._values[buf] * p[:n], dtype=np.uint64, out=sums[1:])
            raw = (sums[ends] - sums[starts]) * inv[starts]
            return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1] \
        if len(col) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def chunks(buf: np.ndarray, offs: np.ndarray, size: int = CHUNK_BYTES
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of whole texts of about ``size`` bytes: (first, last + 1, bytes, offsets)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield lo, hi, buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def runs(is_part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that stay within one text: starts, ends, text index."""
    n = len(is_part)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    first[0] = True
    prev = np.empty(n, dtype=bool)
    prev[0] = False
    prev[1:] = is_part[:-1]
    starts = np.flatnonzero(is_part & (~prev | first[:n]))
    nxt = np.empty(n, dtype=bool)
    nxt[-1] = False
    nxt[:-1] = is_part[1:]
    ends = np.flatnonzero(is_part & (~nxt | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def pieces(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text split at each separator byte, empty pieces included (lines)."""
    cut = np.flatnonzero(separator[buf])
    starts = np.concatenate([offs[:-1], cut + 1])
    owner = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, cut, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else []
    ends[last] = offs[owner[last] + 1] if len(owner) else 0
    return starts, ends, owner


def ngrams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences that stay in one text, and where each begins."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:m] == owner[n - 1:])
    h = np.full(len(at), np.uint64(n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * np.uint64(0xA24BAED4963EE407) + words[at + k])
    return h, at


def bounds(owner: np.ndarray, n_texts: int) -> np.ndarray:
    """n_texts + 1 offsets of each text's items in a list sorted by text."""
    return np.searchsorted(owner, np.arange(n_texts + 1), side="left")
