"""Deletion of repeated runs of lines, found by winnowing over line hashes.

Lines are hashed after trimming white space and lower-casing A-Z; blank lines do not
count and stay where they are. A line shingle is the shortest run of lines from a line
on that has ``min_words`` words. Of the shingles inside every shortest run of lines
with ``sure_words`` words, the one with the least hash is a fingerprint (the last on a
tie), so any repeated run of ``sure_words`` words is sure to share one. A fingerprint
is joined with its first place in the corpus (least document, then least line), not
with all others, so a line that a third of all documents hold costs one row a place.
Around each pair of places the match is extended both ways, line by line, and the run
is deleted where it stands later. The first place of a line is never deleted.

The first place of a fingerprint may hold less than a later repeat does: it has the
fingerprint's lines, and the lines beside them are repeated elsewhere only. So the runs
of ``sure_words`` words around a fingerprint that its match does not cover are hashed
whole and joined, in the same way, with the first place of the same run. Two places of
a run choose the same fingerprint and end their matches with its first place alike, so
either both runs are covered or both are joined: every line of a repeated run of
``sure_words`` words goes, wherever it stands later.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import tokens as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def line_table(hasher: T.Hasher, buf: np.ndarray, offs: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all non-blank lines: hash, text index, number of the line in its text, words."""
    low = T.LOWER[buf]
    starts, ends, owner = T.pieces(low, offs, T.NEWLINE)
    row = np.arange(len(starts)) - np.searchsorted(owner, owner, side="left")
    word_starts, word_ends, _ = T.runs(~T.SPACE[low], offs)
    a = np.searchsorted(word_starts, starts, side="left")
    b = np.searchsorted(word_starts, ends, side="left")
    full = np.flatnonzero(b > a)
    if not len(full):
        return np.zeros(0, np.uint64), full, full, full
    return hasher.spans(low, word_starts[a[full]], word_ends[b[full] - 1]), owner[full], row[full], (b - a)[full]


def winnow(hashes: np.ndarray, words: np.ndarray, min_words: int, sure_words: int
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's lines: the first lines of the fingerprint shingles, their hashes, and the
    first and the end of the lines whose windows have chosen them."""
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + min_words)            # of the shingle from each line
    m = int(np.searchsorted(end, n, side="right"))                   # the rest have too few words
    if m == 0:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    length = end[:m] - np.arange(m)
    shingle = np.full(m, np.uint64(min_words), dtype=np.uint64)
    for k in range(int(length.max())):
        live = np.flatnonzero(length > k)
        with np.errstate(over="ignore"):
            shingle[live] = T.mix(shingle[live] * np.uint64(0xA24BAED4963EE407) + hashes[live + k])
    window = np.searchsorted(total, total[:m] + sure_words)          # end line of each window
    last = np.searchsorted(end[:m], np.minimum(window, n), side="right")
    full = max(1, int(np.searchsorted(window, n, side="right")))     # a short text is one window
    chosen = np.asarray([last[i] - 1 - int(np.argmin(shingle[i:last[i]][::-1])) for i in range(full)], np.int64)
    at, lo = np.unique(chosen, return_index=True)                    # the choice never goes back
    return at, shingle[at], lo, np.append(lo[1:], full)


def _lines(docs: DataFrame, min_words: int, sure_words: int) -> DataFrame:
    """doc, lines (hashes), words, prints (struct of line, hash and range of windows) per document."""
    id_type = docs.schema["doc"].dataType

    def lists(parts: Sequence[np.ndarray]) -> pa.Array:
        cuts = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.Hasher()
        for b in batches:
            for lo, hi, part, at in T.chunks(*T.text_bytes(b.column(1))):
                hashes, own, _, words = line_table(hasher, part, at)
                cut = T.bounds(own, hi - lo)
                h, w = (np.split(v, cut[1:-1]) for v in (hashes, words))
                prints = [winnow(*hw, min_words, sure_words) for hw in zip(h, w)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(lists, (h, w, *zip(*prints)))],
                                                 names=["doc", "lines", "words", "at", "h", "lo", "hi"])

    out = docs.mapInArrow(T.kernel(run), f"doc {id_type.simpleString()}, lines array<bigint>, words array<bigint>, "
                               "at array<bigint>, h array<bigint>, lo array<bigint>, hi array<bigint>")
    return out.select("doc", "lines", "words", F.arrays_zip("at", "h", "lo", "hi").alias("prints"))


def matched_run(x: np.ndarray, y: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """The first and the end of the longest equal run of x through x[i] beside y through y[j]."""
    back = min(i, j)
    same = x[i - back:i][::-1] == y[j - back:j][::-1]
    back = back if same.all() else int(np.argmin(same))
    ahead = min(len(x) - i, len(y) - j)
    same = x[i:i + ahead] == y[j:j + ahead]
    return i - back, i + (ahead if same.all() else int(np.argmin(same)))


def window_ends(words: np.ndarray, sure_words: int) -> np.ndarray:
    """Of each line, and of the end: the end of the shortest run of ``sure_words`` words from it on
    (one more than there are lines, where there is none)."""
    total = np.concatenate([[0], np.cumsum(words)])
    return np.searchsorted(total, total + sure_words)


def uncovered(ends: np.ndarray, lo: int, hi: int, start: int, end: int) -> list[tuple[int, int]]:
    """The runs of the windows lo to hi that do not lie within start to end.

    Those of a line are the shortest run from it on, and every longer one that would have
    too few words without that line: together with those of the other lines they cover
    each line of any run of enough words, within that run.
    """
    n = len(ends) - 1
    if ends[0] > n:                                                  # a short text is one window
        return [] if start == 0 and end == n else [(0, n)]
    return [(s, e) for s in range(lo, hi)
            for e in range(max(int(ends[s]), end + 1 if s >= start else 0), max(ends[s], ends[s + 1] - 1) + 1)]


def run_hashes(lines: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash of the lines of each run, of their number too."""
    length = ends - starts
    h = T.mix(length.astype(np.uint64))
    for k in range(int(length.max(initial=0))):
        live = np.flatnonzero(length > k)
        with np.errstate(over="ignore"):
            h[live] = T.mix(h[live] * np.uint64(0xA24BAED4963EE407) + lines[starts[live] + k])
    return h


def repeated_runs(docs: DataFrame, min_words: int = 8, sure_words: int = 20) -> DataFrame:
    """doc, from_line, to_line (exclusive, among non-blank lines): the later repeated runs.

    ``docs`` has ``doc``, of any type with an order, and ``text``. Rows of one ``doc``
    are one document. Runs of a document may overlap. Every line of a later repeat of a run
    of ``sure_words`` words is in one of them, and each of them repeats a run of ``min_words``
    words that stands earlier.
    """
    lines = cut_lineage(_lines(docs, min_words, sure_words).dropDuplicates(["doc"]), "lines")
    prints = lines.select("doc", F.inline("prints"))
    first = (prints.groupBy("h").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("h", F.col("first.doc").alias("doc0"), F.col("first.at").alias("at0")))
    later = prints.join(first, "h").filter("doc <> doc0 or at <> at0")
    per_pair = (later.groupBy("doc", "doc0")
                .agg(F.array_sort(F.collect_list(F.struct((F.col("at") - F.col("at0")).alias("shift"), "at", "lo", "hi")))
                     .alias("places")))
    joined = (per_pair.join(lines.select(F.col("doc").alias("doc0"), F.col("lines").alias("lines0")), "doc0")
              .join(lines.select("doc", "lines", "words"), "doc")
              .select("doc", "lines", "words", "lines0", *(F.col(f"places.{c}") for c in ("shift", "at", "lo", "hi"))))
    id_type = docs.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, ends, keys = [], [], [], []
            for r in range(b.num_rows):
                x, words, y, *places = (b.column(c)[r].values.to_numpy() for c in range(1, 8))
                reach = window_ends(words, sure_words)
                found, left, seen = [], [], None
                for shift, at, lo, hi in zip(*(p.tolist() for p in places)):
                    if seen != shift or at >= end:                   # else inside the run just found
                        start, end = matched_run(x, y, at, at - shift)
                        found.append((start, end))
                        seen = shift
                    left += uncovered(reach, lo, hi, start, end)
                first, stop = (np.asarray(v, np.int64) for v in zip(*found, *left))
                rows += [r] * len(first)
                starts.append(first)
                ends.append(stop)
                hashes = run_hashes(x.view(np.uint64), first[len(found):], stop[len(found):])
                keys += [None] * len(found) + hashes.view(np.int64).tolist()
            flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, flat), pa.array(keys, pa.int64())],
                names=["doc", "from_line", "to_line", "h"])

    found = cut_lineage(joined.mapInArrow(T.kernel(run), f"doc {id_type.simpleString()}, from_line bigint, to_line bigint, "
                                               "h bigint"), "runs")
    windows = found.filter("h is not null")
    first = (windows.groupBy("h").agg(F.min(F.struct("doc", "from_line")).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("h", "first"))
    again = windows.join(first, "h").filter("doc <> first.doc or from_line <> first.from_line")
    span = ["doc", "from_line", "to_line"]
    return found.filter("h is null").select(span).unionByName(again.select(span))


def dedup_lines(docs: DataFrame, min_words: int = 8, sure_words: int = 20, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The documents with their later repeated runs deleted, and n_lines, n_deleted.

    All columns stay, and all rows; the text column has what is left of the text. A
    null or empty text stays as it is, with 0 lines. Existing columns n_lines and
    n_deleted are replaced. Documents stand in the order of their ids (null first) and,
    where ids repeat, of a hash of their texts; rows equal in both are one document and
    keep the same lines. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_deleted")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    spans = (repeated_runs(docs.select(key.alias("doc"), F.col(f"`{text_col}`").alias("text")), min_words, sure_words)
             .groupBy("doc").agg(F.collect_set(F.struct("from_line", "to_line")).alias("spans"))
             .select(F.col("doc.id").alias("__i"), F.col("doc.h").alias("__h"),
                     F.col("spans.from_line").alias("__from"), F.col("spans.to_line").alias("__to")))
    joined = docs.join(spans, F.col(f"`{id_col}`").eqNullSafe(F.col("__i"))
                       & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__h")), "left").drop("__i", "__h")
    names = docs.columns
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.Hasher()
        for b in batches:
            for lo, hi, part, offs in T.chunks(*T.text_bytes(b.column(text_at))):
                counts, deleted, texts = [], [], []
                _, own, row, _ = line_table(hasher, part, offs)
                cut = T.bounds(own, hi - lo)
                for i in range(hi - lo):
                    text = b.column(text_at)[lo + i].as_py()
                    gone = np.zeros(int(cut[i + 1] - cut[i]), dtype=bool)
                    spans = zip(b.column(len(names))[lo + i].as_py() or (), b.column(len(names) + 1)[lo + i].as_py() or ())
                    for start, end in spans:
                        gone[start:end] = True
                    counts.append(len(gone))
                    deleted.append(int(gone.sum()))
                    if deleted[-1]:
                        drop = set(row[cut[i]:cut[i + 1]][gone].tolist())
                        text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
                    texts.append(text)
                cols = [b.column(i).slice(lo, hi - lo) for i in range(len(names))]
                cols[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(deleted, pa.int64())],
                                                 names=[*names, "n_lines", "n_deleted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(T.kernel(run), f"{schema}, n_lines bigint, n_deleted bigint")
