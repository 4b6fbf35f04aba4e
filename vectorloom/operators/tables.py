"""Embedding tables and models as DataFrames.

A model is a small driver-side record of *metadata* plus DataFrames:

  weights       dense    : (row_id bigint, embedding array<double>)
                uniform  : (row_id bigint, codes array<tinyint>, scale double)
                codebook : (row_id bigint, codes array<tinyint>, scale double)
                pq       : (row_id bigint, codes array<smallint>)
  token_to_row  (token_id bigint, row_id bigint) or None for the identity
  id_map        (old_id bigint, new_id bigint) or None (no remapping)

Only bounded metadata lives on the driver: the width D, bit width, the scalar
codebook (2^bits values) and the PQ codebooks (M x K x D/M values).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.joins import skew_join
from ..functions.levels import uniform_qmax
from . import kernels

DENSE, UNIFORM, CODEBOOK, PQ, PACKED = "dense", "uniform", "codebook", "pq", "packed"


@dataclass
class EmbeddingModel:
    kind: str
    weights: DataFrame
    dim: int
    num_rows: int
    bits: int | None = None
    codebook: list[float] | None = None          # CODEBOOK: stored levels
    pq_codebooks: np.ndarray | None = None       # PQ: (M, K, D/M)
    token_to_row: DataFrame | None = None
    id_map: DataFrame | None = None
    vocab_size: int | None = None
    tokenizer_name: str = "words"
    provenance: list[str] = field(default_factory=list)

    # -- metadata -----------------------------------------------------------
    @property
    def name(self) -> str:
        return "_".join(self.provenance) if self.provenance else "unnamed"

    @property
    def tokens(self) -> int:
        return self.vocab_size if self.vocab_size is not None else self.num_rows

    @property
    def size_bytes(self) -> int:
        return model_size_bytes(self.kind, self.num_rows, self.dim, self.bits,
                                self.pq_codebooks)

    @property
    def size_mb(self) -> float:
        return self.size_bytes / 1e6

    def derive(self, **kw) -> "EmbeddingModel":
        return replace(self, **kw)

    def tagged(self, tag: str, **kw) -> "EmbeddingModel":
        return replace(self, provenance=list(self.provenance) + [tag], **kw)

    # -- decoding -----------------------------------------------------------
    def decode_expr(self) -> Column:
        """array<double> decode expression over the columns of ``weights``.

        Gather-then-decode: callers join the (compact) weights first and apply
        this after the join, so only the rows used are decoded.
        """
        if self.kind == DENSE:
            return V.as_double_array("embedding")
        if self.kind == UNIFORM:
            q = float(uniform_qmax(self.bits))
            return F.transform("codes", lambda c: F.col("scale") * (c.cast("double") / F.lit(q)))
        if self.kind in (CODEBOOK, PACKED):
            cb = F.lit([float(v) for v in self.codebook])
            codes = F.col("codes")
            if self.kind == PACKED:
                from ..functions.bits import unpack
                codes = unpack(F.col("packed"), self.dim, self.bits)
            return F.transform(codes, lambda c: F.col("scale") * F.element_at(cb, c.cast("int") + 1))
        if self.kind == PQ:
            m, k, dsub = self.pq_codebooks.shape
            books = F.lit([[[float(x) for x in row] for row in self.pq_codebooks[j]] for j in range(m)])
            return F.flatten(F.transform(
                F.sequence(F.lit(0), F.lit(m - 1)),
                lambda j: F.element_at(F.element_at(books, j + 1),
                                       F.element_at(F.col("codes"), j + 1).cast("int") + 1)))
        raise ValueError(f"unknown weight kind {self.kind!r}")

    def decoded(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """(*keep, embedding) of rows that hold the columns of ``weights``; codebooks of PQ and
        packed models are broadcast to a kernel instead of written into the plan."""
        if self.kind == PQ:
            return kernels.decode_rows(rows, keep, self.dim, "codes", books=self.pq_codebooks)
        if self.kind == PACKED:
            return kernels.decode_rows(rows, keep, self.dim, "packed", self.bits, self.codebook)
        return rows.select(*keep, self.decode_expr().alias("embedding"))

    def levels(self) -> np.ndarray | None:
        """What a code of ``weights`` stands for, before the scale; a negative code counts from the end.
        None for vectors that are not codes times a scale."""
        if self.kind == UNIFORM:
            return np.roll(np.arange(-128, 128) / float(uniform_qmax(self.bits)), 128)
        return np.asarray(self.codebook, dtype=np.float64) if self.kind in (CODEBOOK, PACKED) else None

    def weight_columns(self) -> list[str]:
        return {DENSE: ["embedding"], UNIFORM: ["codes", "scale"],
                CODEBOOK: ["codes", "scale"], PQ: ["codes"],
                PACKED: ["packed", "scale"]}[self.kind]

    def row_bytes(self) -> int:
        """Estimated in-memory bytes of one weights row (for broadcast checks)."""
        if self.kind == DENSE:
            return 48 + 8 * self.dim
        if self.kind == PQ:
            return 48 + 2 * self.pq_codebooks.shape[0]
        if self.kind == PACKED:
            return 56 + self.dim * self.bits // 8 + 1
        return 56 + self.dim


def model_size_bytes(kind: str, n: int, d: int, bits: int | None,
                     pq_codebooks: np.ndarray | None = None) -> int:
    """dense N*D*4; quantized ceil(N*D*bits/8) + 4N; PQ N*M + 4*M*K*D/M."""
    if kind == DENSE:
        return n * d * 4
    if kind in (UNIFORM, CODEBOOK, PACKED):
        return (n * d * bits + 7) // 8 + 4 * n
    if kind == PQ:
        m, k, dsub = pq_codebooks.shape
        return n * m + 4 * m * k * dsub
    raise ValueError(kind)


def decode(model: EmbeddingModel, rows: DataFrame | None = None) -> DataFrame:
    """Dense (row_id, embedding) of ``model`` (optionally only ``rows``' row_ids)."""
    w = model.weights
    if rows is not None:
        w = w.join(rows.select("row_id").distinct(), "row_id")
    return model.decoded(w, ["row_id"])


def dense_model(weights: DataFrame, dim: int, num_rows: int,
                provenance: list[str] | None = None) -> EmbeddingModel:
    return EmbeddingModel(kind=DENSE, weights=weights, dim=dim, num_rows=num_rows,
                          provenance=list(provenance or []))




def resolved(model: EmbeddingModel) -> DataFrame:
    """(token_id, embedding): every token's vector through token_to_row, decoded."""
    dense = decode(model)
    if model.token_to_row is None:
        return dense.withColumnRenamed("row_id", "token_id")
    return (model.token_to_row.join(dense, "row_id")
            .select("token_id", "embedding"))


def l2_normalise(df: DataFrame, d: int, c: str = "embedding") -> DataFrame:
    return V.l2_normalise_df(df, c, d)


def row_norms(df: DataFrame, d: int, c: str = "embedding", key: str = "row_id") -> DataFrame:
    return df.select(key, V.row_norm_expr(c, d).alias("norm"))


def fold_token_weights(df: DataFrame, weights: DataFrame, d: int,
                       c: str = "embedding") -> DataFrame:
    """Scale each row by its importance weight (rows without a weight kept as is)."""
    w = df.join(weights.select("row_id", F.col("weight").cast("double")), "row_id", "left")
    rest = [k for k in df.columns if k != c]
    return w.select(*rest, V.scale_expr(c, F.coalesce(F.col("weight"), F.lit(1.0))).alias(c))


def remap_token_ids(tokens: DataFrame, id_map: DataFrame | None) -> DataFrame:
    """old -> new token id; ids missing from a non-empty map become 0."""
    if id_map is None:
        return tokens
    m = id_map.select(F.col("old_id").alias("token_id"), "new_id")
    rest = [c for c in tokens.columns if c != "token_id"]
    return (skew_join(tokens, m, "token_id", "left", 48)
            .select(*rest, F.coalesce(F.col("new_id"), F.lit(0)).cast("bigint").alias("token_id")))


def resolve_token_rows(tokens: DataFrame, token_to_row: DataFrame | None) -> DataFrame:
    """Attach the weights row of each token (identity when there is no map)."""
    if token_to_row is None:
        return tokens.withColumn("row_id", F.col("token_id"))
    return skew_join(tokens, token_to_row, "token_id", row_bytes=48)


def gather_rows(ids: DataFrame, model: EmbeddingModel) -> DataFrame:
    """weights[idx]: join on row_id first, decode only the matched rows."""
    return model.decoded(ids.join(model.weights, "row_id"), ids.columns)





