"""Learned compression: centring, covariance, PCA, k-means, product quantization.

Fits are iterative Spark jobs whose *state* is bounded and lives on the driver:
column means (D values), a D x D covariance, k x D centroids, M x K x D/M
codebooks. Each iteration broadcasts the current state to an Arrow kernel that
assigns a partition's rows and adds them up per centroid, and one small ``groupBy``
makes the next state: no join and one exchange. The data itself is never collected, and lineage does
not grow across iterations because the state re-enters as a broadcast value.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA as SparkPCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import kernels
from .tables import DENSE, PQ, EmbeddingModel, decode, resolved

SEED = 42
HASH_MULT = 2654435761          # Knuth's multiplicative hash constant
HASH_MOD = 1 << 32


# --------------------------------------------------------------------------
# moments
# --------------------------------------------------------------------------

def column_means(df: DataFrame, d: int, c: str = "embedding") -> np.ndarray:
    v = F.col(c)
    r = df.agg(*[F.avg(v[i]).alias(f"m{i}") for i in range(d)]).first()
    return np.array([r[f"m{i}"] for i in range(d)], dtype=np.float64)


def center_columns(df: DataFrame, d: int, c: str = "embedding",
                   means: np.ndarray | None = None) -> DataFrame:
    """Subtract the column means (computed by one aggregate, D values)."""
    mu = column_means(df, d, c) if means is None else means
    m = F.lit([float(x) for x in mu])
    rest = [k for k in df.columns if k != c]
    return df.select(*rest, F.transform(V.as_double_array(c),
                                        lambda x, i: x - F.element_at(m, i + 1)).alias(c))


def covariance(df: DataFrame, d: int, c: str = "embedding") -> DataFrame:
    """(i, j, value): second moments sum (x - mean)(x - mean)^T of the rows.

    Each partition adds its rows into one D x D block (numpy), so the shuffle
    carries D^2 values per partition, whatever the row count.
    """
    mu = column_means(df, d, c)
    parts = kernels.gram_partials(df.select(c), mu, vec_col=c)
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


# --------------------------------------------------------------------------
# PCA
# --------------------------------------------------------------------------

def pca(model: EmbeddingModel, dim: int) -> EmbeddingModel:
    """Centre, project on the top-``dim`` principal axes (pyspark.ml PCA), then
    L2-normalise each row. Tag ``pca-{dim}d``."""
    if dim > model.dim:
        raise ValueError(f"pca dim {dim} exceeds the embedding width {model.dim}")
    dense = decode(model) if model.kind != DENSE else model.weights.select("row_id", "embedding")
    centred = center_columns(dense, model.dim)
    vec = centred.select("row_id", array_to_vector("embedding").alias("features"))
    fit = SparkPCA(k=dim, inputCol="features", outputCol="proj").fit(vec)
    out = fit.transform(vec).select("row_id", vector_to_array("proj").alias("embedding"))
    out = V.l2_normalise_df(out, "embedding")
    return model.tagged(f"pca-{dim}d", kind=DENSE, weights=out, dim=dim, bits=None,
                        codebook=None, pq_codebooks=None)


# --------------------------------------------------------------------------
# k-means
# --------------------------------------------------------------------------

def hash_sql(seed: int, turn: int | str = 0) -> str:
    """A pseudo-random number below HASH_MOD per ``row_id``, as SQL that other engines read too;
    ``turn`` (a number or a column) gives independent ones."""
    a = f"((row_id + 1 + {turn} * 7919) * {HASH_MULT} % {HASH_MOD})"
    return f"((({a} - {a} % 65536) / 65536 + {a} * ({a} % 65536 + 1) + {seed}) % {HASH_MOD})"


def _hashed(seed: int, turn: int | str = 0):
    return F.expr(hash_sql(seed, turn)).cast("bigint")


def init_centroids(df: DataFrame, k: int, d: int, seed: int = SEED,
                   c: str = "embedding") -> np.ndarray:
    """The vectors of the k rows that come first by a hash of their id (a distributed top-k)."""
    rows = df.select("row_id", c, _hashed(seed).alias("_h")).orderBy("_h", "row_id").limit(k)
    keys, mat = kernels.collect_block(rows.orderBy("_h", "row_id"), "row_id", c, d, k)
    return mat


def kmeans_assign(df: DataFrame, centroids: np.ndarray, c: str = "embedding") -> DataFrame:
    """(row_id, cid, sq_dist): nearest centroid, lowest id on ties."""
    a = kernels.assign_codes(df.select("row_id", c), centroids[None, :, :], vec_col=c)
    return a.select("row_id", F.col("codes")[0].alias("cid"), "sq_dist")


@dataclass(frozen=True)
class Fit:
    """Codebooks (M, K, D/M) and how the fit ended."""

    books: np.ndarray
    inertia: float
    steps: int
    converged: bool


def step_sums(df: DataFrame, books: np.ndarray, c: str = "embedding") -> DataFrame:
    """(sub, code, n, sq, sums): one pass that assigns and adds up, one small aggregate."""
    parts = kernels.assigned_sums(df, books, c)
    return V.sum_vectors(parts, ["sub", "code"], "sums", books.shape[2],
                         extra=[F.sum("n").alias("n"), F.sum("sq").alias("sq")])


def _collected(sums: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums, counts, squared distance) of the at most M x K rows."""
    total, n, sq = np.zeros(books.shape), np.zeros(books.shape[:2], dtype=np.int64), 0.0
    for r in sums.collect():
        total[r["sub"], r["code"]] = r["sums"]
        n[r["sub"], r["code"]] = r["n"]
        sq += r["sq"]
    return total, n, sq


def lloyd_step(df: DataFrame, books: np.ndarray, c: str = "embedding") -> tuple[np.ndarray, float]:
    """One Lloyd update of all codebooks; empty clusters keep their centroid. (books, inertia before it)."""
    total, n, sq = _collected(step_sums(df, books, c), books)
    return np.where(n[..., None] > 0, total / np.maximum(n, 1)[..., None], books), sq


def lloyd(df: DataFrame, books: np.ndarray, iters: int, tol: float | None, c: str = "embedding") -> Fit:
    """Lloyd updates until no centroid moves by more than ``tol`` in any dimension (None: exactly
    ``iters`` steps). Warns when ``iters`` steps do not get there."""
    inertia, steps, converged = 0.0, 0, False
    while steps < iters and not converged:
        new, inertia = lloyd_step(df, books, c)
        converged = tol is not None and bool(np.abs(new - books).max(initial=0.0) <= tol)
        books, steps = new, steps + 1
    if tol is not None and not converged:
        warnings.warn(f"k-means stopped after {steps} steps while centroids still moved", stacklevel=2)
    return Fit(books, inertia, steps, converged)


def kmeans_step(df: DataFrame, centroids: np.ndarray, c: str = "embedding") -> tuple[np.ndarray, float]:
    """One Lloyd update; empty clusters keep their centroid. Returns (centroids, inertia)."""
    books, inertia = lloyd_step(df, centroids[None], c)
    return books[0], inertia


MAX_STEPS, TOL = 300, 1e-9


def kmeans_fit(df: DataFrame, k: int, d: int, iters: int = MAX_STEPS, seed: int = SEED,
               tol: float | None = TOL, c: str = "embedding") -> np.ndarray:
    """Lloyd iterations from hash-picked rows until the centroids rest (see ``lloyd``)."""
    data = df.select("row_id", V.as_double_array(c).alias(c)).persist()
    try:
        return lloyd(data, init_centroids(data, k, d, seed, c)[None], iters, tol, c).books[0]
    finally:
        data.unpersist()


# --------------------------------------------------------------------------
# mini-batch k-means
# --------------------------------------------------------------------------

def _weighted_seeds(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted points by distance-weighted draws, then moved by a few weighted Lloyd steps."""
    chosen = [int(np.argmax(weights))]
    dist = ((points - points[chosen[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        mass = dist * weights
        total = mass.sum()
        i = int(rng.choice(len(points), p=mass / total)) if total > 0 else int(rng.integers(len(points)))
        chosen.append(i)
        dist = np.minimum(dist, ((points - points[i]) ** 2).sum(1))
    cent = points[chosen].copy()
    for _ in range(10):
        code, _ = kernels.nearest(points, cent)
        mass = np.bincount(code, weights=weights, minlength=k)
        for j in range(points.shape[1]):
            sums = np.bincount(code, weights=weights * points[:, j], minlength=k)
            cent[:, j] = np.where(mass > 0, sums / np.maximum(mass, 1e-300), cent[:, j])
    return cent


def oversampled_seeds(df: DataFrame, k: int, d: int, rounds: int = 5, seed: int = SEED,
                      c: str = "embedding") -> np.ndarray:
    """k seeds by repeated distance-weighted sampling over all rows.

    Each round draws every row with probability 2 k times its share of the squared distance
    to the points drawn so far (about 2 k rows, decided by a hash of the row's id, so a
    repeated task draws the same). The points, about 2 k a round, are weighted by the rows
    nearest to them and reduced to k on the driver.
    """
    points = init_centroids(df, 1, d, seed, c)
    near = kernels.nearest_distance(df, points, vec_col=c).persist()
    for turn in range(1, rounds + 1):
        cost = near.agg(F.sum("sq_dist")).first()[0] or 0.0
        if cost <= 0:
            break
        chance = F.col("sq_dist") * F.lit(2.0 * k / cost)
        drawn = near.where(_hashed(seed, turn) / F.lit(float(HASH_MOD)) < chance).orderBy("row_id")
        _, new = kernels.collect_block(drawn, "row_id", c, d, 2 * k + 20 * int(np.sqrt(2 * k)) + 100)
        if not len(new):
            continue
        last, near = near, kernels.nearest_distance(near, new, before=len(points), vec_col=c).persist()
        points = np.concatenate([points, new])
        near.count()                # made before the table it comes from is let go
        last.unpersist()
    rows = near.groupBy("near").count().collect()       # one per point
    near.unpersist()
    weights = np.zeros(len(points))
    for r in rows:
        weights[r["near"]] = r["count"]
    return _weighted_seeds(points, weights, k, np.random.default_rng(seed))


def minibatch_fit(df: DataFrame, k: int, d: int, batch_rows: int | None = None, batches: int = 30, polish: int = 20,
                  patience: int = 5, seed: int = SEED, c: str = "embedding") -> Fit:
    """Mini-batch k-means from oversampled seeds, then up to ``polish`` full Lloyd steps.

    A batch is a sample of about ``batch_rows`` rows (default 10 k, 1024 at least) picked by a
    hash; a centroid moves to its batch's mean by its share of all rows it has been given so
    far. Batches end after ``batches`` or when the smoothed inertia a row has not improved
    for ``patience`` of them. ``converged`` tells whether the last full step moved the inertia by
    less than a thousandth.
    """
    data = df.select("row_id", V.as_double_array(c).alias(c)).persist()
    try:
        n = data.count()
        cent = oversampled_seeds(data, k, d, seed=seed, c=c)[None]
        given, smooth, best, waited = np.zeros((1, k)), None, np.inf, 0
        size = batch_rows or max(1024, 10 * k)
        share, steps = min(1.0, size / max(n, 1)), 0
        for turn in range(1, batches + 1 if share < 1 else 1):      # a batch of all rows is a Lloyd step
            part = data.where(_hashed(seed, 100 + turn) < F.lit(int(share * HASH_MOD)))
            total, count, sq = _collected(step_sums(part, cent, c), cent)
            given += count
            cent = cent + (total - count[..., None] * cent) / np.maximum(given, 1)[..., None]
            per_row, steps = sq / max(count.sum(), 1), turn
            smooth = per_row if smooth is None else smooth + (per_row - smooth) * min(1.0, 2 * share * 10)
            best, waited = (smooth, 0) if smooth < best * (1 - 1e-4) else (best, waited + 1)
            if waited >= patience:
                break
        before, inertia, converged = np.inf, np.inf, False
        for _ in range(polish):
            cent, inertia = lloyd_step(data, cent, c)
            steps += 1
            converged = before - inertia <= 1e-3 * inertia
            if converged:
                break
            before = inertia
        return Fit(cent, inertia, steps, converged)
    finally:
        data.unpersist()


def cluster_global(model: EmbeddingModel, k: int, method: str = "minibatch", iters: int = MAX_STEPS,
                   tol: float | None = TOL) -> EmbeddingModel:
    """k-means over every token's (decoded) vector: weights -> k centroids,
    token_to_row -> assignment. k >= vocabulary size passes the vectors through.

    ``method``: ``minibatch`` (see ``minibatch_fit``) or ``lloyd`` (full steps from hash-picked
    rows until the centroids rest). Warns when the fit did not converge.
    """
    spark = model.weights.sparkSession
    toks = resolved(model).withColumnRenamed("token_id", "row_id")
    n = model.tokens
    tag = f"cluster-k{k}"
    if k >= n:
        return model.tagged(tag, kind=DENSE, weights=toks, num_rows=n, bits=None, codebook=None,
                            pq_codebooks=None, token_to_row=None, vocab_size=n)
    if method == "minibatch":
        fit = minibatch_fit(toks, k, model.dim)
        if not fit.converged:
            warnings.warn(f"{tag}: still improving after {fit.steps} steps", stacklevel=2)
        cent = fit.books[0]
    elif method == "lloyd":
        cent = kmeans_fit(toks, k, model.dim, iters, tol=tol)
    else:
        raise ValueError(f"no way of clustering is called {method!r}; there are 'minibatch' and 'lloyd'")
    weights = spark.createDataFrame([(i, [float(x) for x in cent[i]]) for i in range(k)],
                                    "row_id bigint, embedding array<double>")
    t2r = kmeans_assign(toks, cent).select(F.col("row_id").alias("token_id"),
                                           F.col("cid").cast("bigint").alias("row_id"))
    return model.tagged(tag, kind=DENSE, weights=weights, num_rows=k, bits=None, codebook=None,
                        pq_codebooks=None, token_to_row=t2r, vocab_size=n)


# --------------------------------------------------------------------------
# product quantization
# --------------------------------------------------------------------------

def _check_pq(d: int, m: int, k: int) -> int:
    if d % m:
        raise ValueError(f"vectors of width {d} cannot be cut into {m} equal parts")
    if not 0 < k <= 256:
        raise ValueError(f"a code is one byte, so a part has 1 to 256 centroids, not {k}")
    return d // m


def pq_encode(df: DataFrame, books: np.ndarray, c: str = "embedding") -> DataFrame:
    """(row_id, codes array<smallint>): nearest code per sub-vector."""
    a = kernels.assign_codes(df.select("row_id", c), books, vec_col=c)
    return a.select("row_id", F.col("codes").cast("array<smallint>").alias("codes"))


def pq_seeds(df: DataFrame, m: int, k: int, d: int, seed: int = SEED, c: str = "embedding") -> np.ndarray:
    """(M, K, D/M) first centroids: each part takes k rows of its own, the first by its own hash."""
    dsub = _check_pq(d, m, k)
    first = Window.partitionBy("sub").orderBy("h", "row_id")
    picked = (df.select("row_id", c, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("sub"))
              .select("row_id", "sub", _hashed(seed, "sub").alias("h"),
                      F.slice(V.as_double_array(c), F.col("sub") * dsub + 1, dsub).alias("part"))
              .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k))
    books = np.zeros((m, k, dsub))
    for r in picked.orderBy("sub", "nth").collect():         # M x K rows
        books[r["sub"], r["nth"] - 1:] = r["part"]           # a table of fewer rows repeats its last
    return books


def pq_fit(df: DataFrame, m: int, k: int, d: int, iters: int = MAX_STEPS, seed: int = SEED,
           tol: float | None = TOL, c: str = "embedding") -> np.ndarray:
    """(M, K, D/M) codebooks: Lloyd steps of all parts together until they rest (see ``lloyd``)."""
    data = df.select("row_id", V.as_double_array(c).alias(c)).persist()
    try:
        return lloyd(data, pq_seeds(data, m, k, d, seed, c), iters, tol, c).books
    finally:
        data.unpersist()


def pq(model: EmbeddingModel, num_subvectors: int, centroids_per_sub: int = 256,
       iters: int = MAX_STEPS, tol: float | None = TOL) -> EmbeddingModel:
    """Decode to dense, fit M codebooks, encode. Tag ``pq-m{M}-k{K}``."""
    _check_pq(model.dim, num_subvectors, centroids_per_sub)
    dense = decode(model) if model.kind != DENSE else model.weights.select("row_id", "embedding")
    books = pq_fit(dense, num_subvectors, centroids_per_sub, model.dim, iters, tol=tol)
    codes = pq_encode(dense, books)
    return model.tagged(f"pq-m{num_subvectors}-k{centroids_per_sub}", kind=PQ, weights=codes,
                        bits=None, codebook=None, pq_codebooks=books)
