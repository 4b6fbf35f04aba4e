"""Scalar quantization of embedding tables: uniform and rotation + Max-Lloyd.

Quantizers are narrow projections (no shuffle): one ``aggregate`` fold per row
finds the row scale and its finish lambda emits the codes. Rotations multiply
in an Arrow kernel (sums and differences, or a broadcast D x D matrix).
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions import levels
from ..functions.levels import (butterfly, hadamard_signs, lloyd_levels, midpoints, qr_rotation,
                                stored_codebook, uniform_qmax)
from . import kernels
from .tables import CODEBOOK, PQ, UNIFORM, EmbeddingModel


cloudpickle.register_pickle_by_value(levels)        # executors need only numpy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --------------------------------------------------------------------------
# row expressions
# --------------------------------------------------------------------------

def uniform_codes_df(df: DataFrame, d: int, bits: int, c: str = "embedding") -> DataFrame:
    """(.., codes array<tinyint>, scale double): code = clamp(rint(x/scale*q_max)),
    scale = max(max|x|, 1e-8). One fold per row; the finish lambda emits both."""
    q = float(uniform_qmax(bits))
    rest = [k for k in df.columns if k != c]
    v = V.as_double_array(c)

    def finish(m):
        sc = F.greatest(m, F.lit(V.NORM_FLOOR))
        codes = F.transform(v, lambda x: F.least(F.greatest(F.rint(x / sc * F.lit(q)), F.lit(-q - 1.0)),
                                                 F.lit(q)).cast("tinyint"))
        return F.struct(codes.alias("codes"), sc.alias("scale"))

    st = F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)), finish)
    return df.select(*rest, st.alias("_q")).select(*rest, "_q.codes", "_q.scale")


def codebook_codes_df(df: DataFrame, d: int, bits: int, c: str = "embedding") -> DataFrame:
    """(.., codes array<tinyint>, scale double): nearest Max-Lloyd level of
    x * sqrt(D) / ||x|| (first level on ties, via the level midpoints),
    scale = ||x|| (floored 1e-8)."""
    mids = midpoints(lloyd_levels(bits))
    rest = [k for k in df.columns if k != c]
    v = V.as_double_array(c)
    sq = float(math.sqrt(d))

    def finish(a):
        sc = F.greatest(F.sqrt(a), F.lit(V.NORM_FLOOR))

        def code(x):
            z = x / sc * F.lit(sq)
            return V.tree_sum([F.when(z > F.lit(m), 1).otherwise(0) for m in mids]).cast("tinyint")
        return F.struct(F.transform(v, code).alias("codes"), sc.alias("scale"))

    st = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x, finish)
    return df.select(*rest, st.alias("_q")).select(*rest, "_q.codes", "_q.scale")


def hadamard_df(df: DataFrame, d: int, c: str = "embedding", out: str | None = None,
                seed: int | None = None) -> DataFrame:
    """Random-sign Walsh-Hadamard rotation: rows @ (diag(s) H / sqrt(D)),
    H[i, j] = (-1)^popcount(i & j), as log2(D) passes of sums and differences over a batch.
    A width that is no power of two is rotated in blocks that are."""
    signs = np.array(hadamard_signs(d) if seed is None else hadamard_signs(d, seed), dtype=np.float64)
    return kernels.rotate(df, lambda x: butterfly(x, signs), d, vec_col=c, out=out)


# --------------------------------------------------------------------------
# model-level operators
# --------------------------------------------------------------------------

def quantize_uniform(model: EmbeddingModel, bits: int) -> EmbeddingModel:
    w = uniform_codes_df(model.weights.select("row_id", "embedding"), model.dim, bits)
    return model.tagged(f"int{bits}", kind=UNIFORM, weights=w, bits=bits, codebook=None)


def rotate_hadamard(df: DataFrame, d: int, c: str = "embedding") -> DataFrame:
    return hadamard_df(df, d, c)


def rotate_qr(df: DataFrame, d: int, c: str = "embedding") -> DataFrame:
    """Rows times the seeded QR orthogonal matrix (broadcast D x D, numpy kernel)."""
    return kernels.matmul(df, qr_rotation(d), vec_col=c)


def quantize_codebook(model: EmbeddingModel, bits: int) -> EmbeddingModel:
    w = codebook_codes_df(model.weights.select("row_id", "embedding"), model.dim, bits)
    return model.derive(kind=CODEBOOK, weights=w, bits=bits,
                        codebook=stored_codebook(bits, model.dim))


def turbo_lloyd(model: EmbeddingModel, bits: int, rotation: str = "hadamard") -> EmbeddingModel:
    """Rotate, then snap to the Max-Lloyd codebook at ``bits`` bits."""
    lloyd_levels(bits)  # validate early
    d = model.dim
    dense = model.weights.select("row_id", "embedding")
    if rotation == "hadamard" and d & (d - 1) == 0:
        rot = rotate_hadamard(dense, d)
    elif rotation in ("hadamard", "qr"):
        rot = rotate_qr(dense, d)
    else:
        raise ValueError(f"unknown rotation {rotation!r}")
    w = codebook_codes_df(rot, d, bits)
    return model.tagged(f"turbo-lloyd-{bits}", kind=CODEBOOK, weights=w, bits=bits,
                        codebook=stored_codebook(bits, d))


def quantize(model: EmbeddingModel, bits: int = 4, method: str = "turbo-lloyd",
             rotation: str = "hadamard") -> EmbeddingModel:
    """Dispatch by method; an already quantized model is returned unchanged."""
    if model.kind in (UNIFORM, CODEBOOK):
        return model
    if model.kind == PQ:
        raise TypeError("quantize of a product-quantized model: decode it first")
    if method == "uniform":
        return quantize_uniform(model, bits)
    if method == "turbo-lloyd":
        return turbo_lloyd(model, bits, rotation)
    raise ValueError(f"no quantizer is called {method!r}; there are 'uniform' and 'turbo-lloyd'")


def quantization_error(original: DataFrame, model: EmbeddingModel,
                       rotated: bool = False) -> DataFrame:
    """Mean squared reconstruction error over all elements (one row).

    For turbo-lloyd models the reference for the error is the rotated table
    (pass it as ``original`` with ``rotated=True``), since rotation is not undone.
    """
    d = model.dim
    dec = model.decoded(model.weights, ["row_id"]).withColumnRenamed("embedding", "_y")
    j = original.select("row_id", V.as_double_array("embedding").alias("_x")).join(dec, "row_id")
    return j.agg((F.sum(V.sq_dist_expr("_x", "_y")) / (F.count(F.lit(1)) * F.lit(float(d)))).alias("mse"),
                 F.count(F.lit(1)).alias("rows"))
