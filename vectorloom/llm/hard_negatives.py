"""Hard negatives by threshold joins over an inverted index (L2AP style).

An anchor's positives are its best rows of the same label, its negatives the best rows of
other labels within a window of scores below each positive. Both are searches for the first
k rows of a window [threshold, high]:

1. rows and anchors are dealt into tiles and blocks; every (tile, block) is one group of a
   cogroup, so no side passes the driver and nothing is broadcast but a small pilot;
2. in a tile, dimensions are ordered by their weight, the lightest first. A row's leading
   dimensions are left out of the index as long as their norm times the block's largest norm
   over them stays below the least threshold: no pair reaches a threshold through them alone;
3. partial scores are summed over the indexed dimensions, pairs whose partial score plus the
   product of the remaining norms stays below the anchor's threshold are dropped, and the
   others are finished from the dimensions left out;
4. thresholds start high, at the best row of the pilot (a bounded sample) in the window.
   Windows that do not fill are searched again with a lower threshold: the k-th row of the
   pilot, which is sure to fill the window, or the window's own lower end.

The pilot decides only how much work is done. All scores are exact integers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import share

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)          # doubles add integers exactly below this
STEPS, SLACK = 8, 1 + 1e-9      # groups of dimensions; rounding of the norm bounds
ANCHORS, ROWS = 256, 4096       # pairs scored at once


def whole(column: pa.Array | pa.ChunkedArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of each component; shorter vectors are filled up with zeros.

    A float64 matrix where that is exact, else one of Python integers.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() * scale >= EXACT:
        units = np.array([scale * int(x) if abs(x) >= EXACT else floor(scale * x) for x in flat], dtype=object)
    else:
        units = np.floor(flat * scale)
    if (lengths == width).all():
        return units.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=units.dtype)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = units
    return out


def all_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """The exact products of both sides where doubles are too short for them, else None."""
    def longest(m: np.ndarray) -> float:
        return float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max()) if len(m) else 0.0
    if x.dtype != object and y.dtype != object and longest(x) * longest(y) * SLACK < EXACT:
        return None
    exact = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) \
        @ np.array([[int(v) for v in row] for row in y], dtype=object).reshape(y.shape).T
    return np.array([[min(max(int(s), LEAST), MOST) for s in row] for row in exact],
                    dtype=object).reshape(len(x), len(y))


class Best:
    """The first k rows of each window: greater scores first, then smaller ids; repeats count once."""

    def __init__(self, k: int, exact: bool) -> None:
        self.k, kind = k, np.int64 if exact else np.float64
        self.key, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        key, ids = np.concatenate([self.key, key]), np.concatenate([self.id, ids])
        score = np.concatenate([self.score, score.astype(self.score.dtype)])
        order = np.lexsort((ids, ~score if score.dtype == np.int64 else -score, key))
        key, ids, score = key[order], ids[order], score[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        key, ids, score = key[new], ids[new], score[new]
        nth = np.arange(len(key)) - np.searchsorted(key, key, side="left")
        kept = nth < self.k
        self.key, self.id, self.score, self.nth = key[kept], ids[kept], score[kept], nth[kept]

    def raise_to(self, low: np.ndarray) -> None:
        """Full windows accept nothing below their last row any more."""
        last = self.nth == self.k - 1
        flat = low.reshape(-1)
        flat[self.key[last]] = np.maximum(flat[self.key[last]], self.score[last])


def search(y: np.ndarray, y_id: np.ndarray, y_label: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_label: np.ndarray,
           low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """(anchor, window, id, score) of the first k rows y of every window [low, high] of the anchors x.

    low and high: one row of windows per anchor (int64); a window with high < low is none.
    Rows of the anchor's own id never count; ``same`` asks for rows of its label, else of others.
    """
    n_windows = low.shape[1]
    exact = all_scores(x, y)
    best = Best(k, exact is not None)
    kind = np.int64 if exact is not None else np.float64
    low, high = low.astype(kind), high.astype(kind)
    dead = high < low
    low[dead] = MOST if kind is np.int64 else np.inf

    def take(a: np.ndarray, r: np.ndarray, s: np.ndarray) -> None:
        fits = ((x_label[a] == y_label[r]) == same) & (x_id[a] != y_id[r])
        a, r, s = a[fits], r[fits], s[fits]
        found = [[], [], []]
        for w in range(n_windows):
            inside = (s >= low[a, w]) & (s <= high[a, w]) & ~dead[a, w]
            found[0].append(a[inside] * n_windows + w)
            found[1].append(y_id[r[inside]])
            found[2].append(s[inside])
        best.add(*(np.concatenate(f) for f in found))
        best.raise_to(low)

    if exact is not None:
        for a in range(0, len(x), ANCHORS):
            part = exact[a:a + ANCHORS]
            i, r = np.indices(part.shape).reshape(2, -1)
            take(i + a, r, part.reshape(-1).astype(np.int64))
        return best.key // n_windows, best.key % n_windows, best.id, best.score

    weight = (y ** 2).sum(axis=0)
    dims = np.argsort(weight, kind="stable")
    y, x = np.ascontiguousarray(y[:, dims]), np.ascontiguousarray(x[:, dims])
    ends = np.unique(np.linspace(0, y.shape[1], STEPS + 1).astype(int))

    def norms(m: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(m), m.shape[1] + 1))
        np.cumsum(m ** 2, axis=1, out=sums[:, 1:])
        return np.sqrt(sums[:, ends])
    y_norm, x_norm = norms(y), norms(x)
    by_threshold = np.argsort(low.min(axis=1), kind="stable")[::-1]
    for at in range(0, len(x), ANCHORS):
        block = by_threshold[at:at + ANCHORS]
        block = block[~dead[block].all(axis=1)]
        if not len(block):
            continue
        reach = y_norm * x_norm[block].max(axis=0) * SLACK
        left_out = np.maximum((reach < low[block].min()).sum(axis=1) - 1, 0)     # leading groups not indexed
        order = np.argsort(left_out, kind="stable")
        order = order[reach[order, -1] >= low[block].min()]
        starts = np.searchsorted(left_out[order], np.arange(len(ends)))
        for step, first in enumerate(starts):
            last = starts[step + 1] if step + 1 < len(starts) else len(order)
            cut = ends[step]
            for lo in range(first, last, ROWS):
                rows = order[lo:min(lo + ROWS, last)]
                partial = x[block, cut:] @ y[rows, cut:].T
                need = low[block].min(axis=1)[:, None]
                a, r = np.nonzero(partial + x_norm[block, step][:, None] * y_norm[rows, step] * SLACK >= need)
                s = partial[a, r]
                if cut and len(a) * 4 > partial.size:
                    s += (x[block, :cut] @ y[rows, :cut].T)[a, r]
                elif cut:
                    for p in range(0, len(a), 1 << 16):
                        q = slice(p, p + (1 << 16))
                        s[q] += np.einsum("ij,ij->i", x[block[a[q]], :cut], y[rows[r[q]], :cut])
                take(block[a], rows[r], s)
    return best.key // n_windows, best.key % n_windows, best.id, best.score


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values).astype(np.int64))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batches(frame: DataFrame, run, added: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{schema}, {added}")


class Miner:
    """The prepared rows and anchors, their sizes and the pilot."""

    def __init__(self, rows: DataFrame, is_anchor: Column, scale: int, tile_bytes: int, pilot_rows: int) -> None:
        spark = rows.sparkSession
        self.scale = scale
        self.rows = rows
        n, width, n_anchors = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)),
                                       F.count_if(is_anchor)).first()
        self.width = max(width, 1)
        per_tile = max(1, tile_bytes // (8 * self.width))
        cores = spark.sparkContext.defaultParallelism
        self.tiles = max(-(-n // per_tile), min(4 * cores, -(-n // 512)), 1)
        self.blocks = max(1, -(-n_anchors // per_tile))
        picked = min(pilot_rows, per_tile)
        share_of = int(min(1.0, picked / max(n, 1)) * (1 << 20)) + 1
        sample = (rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < share_of)
                  .limit(2 * picked).toArrow())           # at most two tiles of rows
        self.pilot = share(spark, (np.asarray(sample.column("id")), np.asarray(sample.column("label")),
                                   whole(sample.column("v"), scale, self.width)))
        chosen = rows.filter(is_anchor).distinct().withColumn("a", F.monotonically_increasing_id())
        self.anchors = cut_lineage(chosen, "anchors")     # written, so that the numbers stay

    def estimate(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """Adds ``try_low`` and ``sure_low``, one value per window, from the pilot's best and k-th row."""
        pilot, scale, width = self.pilot, self.scale, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y_id, y_label, y = pilot()
            for b in filter(len, batches):
                t = pa.Table.from_batches([b])
                low, high = _matrix(t["low"]), _matrix(t["high"])
                a, w, _, s = search(y, y_id, y_label, whole(t["v"], scale, width), np.asarray(t["id"]),
                                    np.asarray(t["label"]), low, high, k, same)
                tried, sure = low.copy(), low.copy()
                key = a * low.shape[1] + w
                first = np.searchsorted(key, key, side="left") == np.arange(len(key))
                tried[a[first], w[first]] = s[first].astype(np.int64)
                nth = np.arange(len(key)) - np.searchsorted(key, key, side="left") == k - 1
                sure[a[nth], w[nth]] = s[nth].astype(np.int64)
                ends = pa.array(np.arange(len(low) + 1, dtype=np.int32) * low.shape[1])
                lists = [pa.ListArray.from_arrays(ends, pa.array(m.reshape(-1))) for m in (tried, sure)]
                yield pa.RecordBatch.from_arrays([*b.columns, *lists],
                                                 names=[*b.schema.names, "try_low", "sure_low"])

        return _batches(anchors, run, "try_low array<bigint>, sure_low array<bigint>")

    def join(self, anchors: DataFrame, low: str, k: int, same: bool) -> DataFrame:
        """(a, w, id, score, nth): the first k rows of every window from ``low`` on, over all tiles."""
        scale, width = self.scale, self.width
        tiles, blocks = self.tiles, self.blocks

        def run(rows: pa.Table, block: pa.Table) -> pa.Table:
            a, w, ids, s = search(whole(rows["v"], scale, width), np.asarray(rows["id"]), np.asarray(rows["label"]),
                                  whole(block["v"], scale, width), np.asarray(block["id"]),
                                  np.asarray(block["label"]), _matrix(block["low"]).copy(), _matrix(block["high"]),
                                  k, same) if len(rows) and len(block) else (np.zeros(0, np.int64),) * 4
            return pa.table({"a": np.asarray(block["a"])[a], "w": pa.array(w.astype(np.int32)), "id": _longs(ids),
                             "score": _longs(s)})

        dealt = (self.rows.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(tiles)))
                 .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
        sent = (anchors.select("a", "id", "label", "v", F.col(low).alias("low"), "high",
                               F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("b"))
                .withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint")))))
        parts = min(tiles * blocks, 1 << 16)
        both = (dealt.repartition(parts, "g", "b").groupBy("g", "b")
                .cogroup(sent.repartition(parts, "g", "b").groupBy("g", "b")))
        found = both.applyInArrow(run, "a bigint, w int, id bigint, score bigint")
        order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
        return (found.withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= k)
                .dropDuplicates(["a", "w", "id", "score", "nth"]))

    def fill(self, anchors: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """The first k rows of every window of the anchors, thresholds lowered until windows fill."""
        anchors = cut_lineage(self.estimate(anchors, k, same), f"{name}_anchors")
        first = cut_lineage(self.join(anchors, "try_low", k, same), f"{name}_first")
        full = first.filter(F.col("nth") == k).select("a", F.col("w").alias("full_w"))
        lists = full.groupBy("a").agg(F.collect_set("full_w").alias("full_w"))     # at most the windows of an anchor
        open_ = anchors.join(lists, "a", "left")
        # windows that are full, or were searched down to their end, are closed: high below low
        shut = F.when(F.array_contains(F.coalesce("full_w", F.array().cast("array<int>")), F.col("i"))
                      | (F.col("lo") == F.col("tried")), F.lit(LEAST)).otherwise(F.col("hi"))
        each = (open_.select("a", "id", "label", "v", "full_w", F.posexplode(
            F.arrays_zip(F.col("sure_low").alias("sure"), F.col("high").alias("hi"),
                         F.col("low").alias("lo"), F.col("try_low").alias("tried"))).alias("i", "z"))
            .select("a", "id", "label", "v", "full_w", "i", "z.*")
            .withColumn("again", (F.col("hi") >= F.col("lo")) & (shut != F.lit(LEAST))))
        windows = (each.groupBy("a").agg(F.max("again").alias("again"),
                                         F.sort_array(F.collect_list(F.struct(
                                             "i", F.when(F.col("again"), F.col("sure")).otherwise(F.lit(0)).alias("l"),
                                             F.when(F.col("again"), F.col("hi")).otherwise(F.lit(-1)).alias("h"))))
                                         .alias("z")).filter("again")
                   .select("a", F.col("z.l").alias("sure_low"), F.col("z.h").alias("high")))
        left = cut_lineage(anchors.select("a", "id", "label", "v").join(windows, "a"), f"{name}_open")
        if left.isEmpty():
            return first
        second = self.join(left, "sure_low", k, same)
        redone = left.select("a", F.posexplode("high").alias("w", "h")).filter("h >= 0").select("a", "w")
        return cut_lineage(first.join(redone, ["a", "w"], "left_anti").unionByName(second), f"{name}_all")


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", positives: int = 5, negatives: int = 3, low_percent: int = 50,
         high_percent: int = 95, scale: int = 256, tile_bytes: int = 32 << 20, pilot_rows: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of the vectors' ``floor(scale * x)``. An anchor's positives
    are its first ``positives`` other rows of its label (all, if fewer); for each of them the
    first ``negatives`` rows of other labels with low_percent * positive_score <= 100 *
    negative_score <= high_percent * positive_score are returned. Ties go to the smaller id.

    Rows with a null id or label, a null vector, or a null or non-finite component take no
    part. A shorter vector counts as filled up with zeros, an empty one as all zeros. Rows of
    the anchor's own id are neither its positives nor its negatives; rows of another id that
    repeat count once, rows of one id with different scores count each. Anchors that repeat
    wholly count once. Scores beyond a long count as the nearest long. Other columns are
    ignored; an empty table gives an empty result. ``is_anchor`` is a condition on the
    columns ``id`` and ``label``.

    ``tile_bytes`` bounds a tile and a block of anchors in a task, ``pilot_rows`` the sample
    that sets the first thresholds; the result depends on neither.
    """
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    vector = F.col(f"`{vector_col}`") if kind == "float" else F.col(f"`{vector_col}`").cast("array<double>")
    rows = (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                           F.col(f"`{label_col}`").cast("bigint").alias("label"), vector.alias("v"))
            .filter("id is not null and label is not null and v is not null").filter(~F.coalesce(bad, F.lit(False))))
    miner = Miner(rows, is_anchor, scale, tile_bytes, pilot_rows)
    whole_range = miner.anchors.select("*", F.array(F.lit(LEAST)).alias("low"), F.array(F.lit(MOST)).alias("high"))
    best = cut_lineage(miner.fill(whole_range, positives, True, "positives").select(
        "a", (F.col("nth") - 1).alias("w"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")
    # floor and ceiling of a percentage, in decimals so that no product overflows
    low = F.expr(f"cast(ceil(cast(positive_score as decimal(20,0)) * {low_percent} / 100) as bigint)")
    high = F.expr(f"cast(floor(cast(positive_score as decimal(20,0)) * {high_percent} / 100) as bigint)")
    windows = (best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("w", low.alias("l"), high.alias("h"))))
                                     .alias("z")))                  # at most ``positives`` per anchor
    def field(name: str, absent: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(
            F.get(F.col("z"), i)[name], F.lit(absent).cast("bigint")))
    windows = windows.select("a", field("l", 0).alias("low"), field("h", -1).alias("high"))
    # a negative score has an empty window (high below low); [0, -1] says the same
    empty = F.arrays_zip("low", "high")
    windows = windows.select(
        "a", F.transform(empty, lambda z: F.when(z["high"] < z["low"], 0).otherwise(z["low"])).alias("low"),
        F.transform(empty, lambda z: F.when(z["high"] < z["low"], -1).otherwise(z["high"])).alias("high"))
    found = miner.fill(miner.anchors.join(windows, "a"), negatives, False, "negatives")
    found = found.select("a", "w", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "nth")
    return (best.join(found, ["a", "w"])
            .join(miner.anchors.select("a", F.col("id").alias("anchor_id")), "a")
            .select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))
