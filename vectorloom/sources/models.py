"""Model tables on disk (parquet), packed exports, and their legacy forms.

A saved model is a folder:  <dir>/<name>/weights, token_to_row (optional),
meta (one JSON row: kind, dim, num_rows, bits, codebook, pq codebooks,
provenance, tokenizer). A packed export is <path>.packed/{packed, meta} with
packed(row_id, packed binary, scale double).
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.levels import lloyd_levels, uniform_codebook, uniform_qmax
from ..operators.tables import CODEBOOK, UNIFORM, EmbeddingModel, decode

PACKED = "packed"


def _write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "meta string") \
        .coalesce(1).write.mode("overwrite").text(path)


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_model(model: EmbeddingModel, directory: str) -> str:
    """Write weights (+ map, meta) under ``directory/<model.name>``; returns the path."""
    spark = model.weights.sparkSession
    path = f"{directory.rstrip('/')}/{model.name}"
    model.weights.write.mode("overwrite").parquet(f"{path}/weights")
    if model.token_to_row is not None:
        model.token_to_row.write.mode("overwrite").parquet(f"{path}/token_to_row")
    if model.id_map is not None:
        model.id_map.write.mode("overwrite").parquet(f"{path}/id_map")
    meta = {"kind": model.kind, "dim": model.dim, "num_rows": model.num_rows, "bits": model.bits,
            "codebook": model.codebook,
            "pq_codebooks": None if model.pq_codebooks is None else model.pq_codebooks.tolist(),
            "has_token_to_row": model.token_to_row is not None,
            "has_id_map": model.id_map is not None, "vocab_size": model.vocab_size,
            "tokenizer_name": model.tokenizer_name, "provenance": model.provenance}
    _write_meta(spark, meta, f"{path}/meta")
    return path


def load_model(spark: SparkSession, path: str) -> EmbeddingModel:
    """Read a saved model; the legacy single 'quantized' kind is upgraded.

    Legacy: codes may sit in ``int8_data``; bits default to 8; a codebook
    flagged but missing is rebuilt as lloyd(bits) / sqrt(D).
    """
    meta = _read_meta(spark, f"{path}/meta")
    w = spark.read.parquet(f"{path}/weights")
    kind = meta["kind"]
    bits = meta.get("bits")
    codebook = meta.get("codebook")
    if kind == "quantized":
        if "codes" not in w.columns and "int8_data" in w.columns:
            w = w.withColumnRenamed("int8_data", "codes")
        bits = bits if bits is not None else 8
        if meta.get("has_codebook") or codebook is not None:
            kind = CODEBOOK
            if codebook is None:
                codebook = [v / math.sqrt(meta["dim"]) for v in lloyd_levels(bits)]
        else:
            kind = UNIFORM
    pq = meta.get("pq_codebooks")
    return EmbeddingModel(
        kind=kind, weights=w, dim=int(meta["dim"]), num_rows=int(meta["num_rows"]), bits=bits,
        codebook=codebook, pq_codebooks=None if pq is None else np.asarray(pq),
        token_to_row=spark.read.parquet(f"{path}/token_to_row") if meta.get("has_token_to_row") else None,
        id_map=spark.read.parquet(f"{path}/id_map") if meta.get("has_id_map") else None,
        vocab_size=meta.get("vocab_size"), tokenizer_name=meta.get("tokenizer_name", "words"),
        provenance=list(meta.get("provenance") or []))


# --------------------------------------------------------------------------
# packed export
# --------------------------------------------------------------------------

def export_packed(model: EmbeddingModel) -> tuple[DataFrame, dict]:
    """Quantized model -> (packed(row_id, packed, scale), meta).

    Uniform codes are signed; they are shifted by q_max + 1 into [0, 2^bits)
    before packing and the implicit codebook (-q_max-1 .. q_max) / q_max is
    stored, so unpack + lookup reproduces the uniform decode exactly.
    """
    if model.kind not in (UNIFORM, CODEBOOK):
        raise TypeError(f"only scalar codes can be packed, and the weights are {model.kind!r}: quantize them first")
    d, bits = model.dim, model.bits
    if model.kind == UNIFORM:
        shift = uniform_qmax(bits) + 1
        codes = F.transform("codes", lambda c: c.cast("int") + shift)
        codebook, method = uniform_codebook(bits), "uniform"
    else:
        codes, codebook, method = F.col("codes"), list(model.codebook), "turbo-lloyd"
    packed = model.weights.select("row_id", B.pack(codes, d, bits).alias("packed"), "scale")
    meta = {"codebook": codebook, "embed_dim": d, "vocab_size": model.tokens, "bits": bits,
            "tokenizer_name": model.tokenizer_name, "method": method,
            "source_model": model.provenance[0] if model.provenance else ""}
    return packed, meta


def packed_model(packed: DataFrame, meta: dict) -> EmbeddingModel:
    """A model whose weights stay packed; decoding happens after the row gather."""
    return EmbeddingModel(kind=PACKED, weights=packed, dim=int(meta["embed_dim"]),
                          num_rows=int(meta["vocab_size"]), bits=int(meta["bits"]),
                          codebook=list(meta["codebook"]),
                          tokenizer_name=meta.get("tokenizer_name", "words"),
                          provenance=[meta.get("source_model") or "packed", meta.get("method", "")])


def decode_packed(packed: DataFrame, meta: dict) -> DataFrame:
    """(row_id, embedding) = scale * codebook[unpacked code]."""
    return decode(packed_model(packed, meta))


def save_packed(packed: DataFrame, meta: dict, path: str) -> str:
    """Write a packed export; the ``.packed`` suffix is forced."""
    if not path.endswith(".packed"):
        path = path + ".packed"
    spark = packed.sparkSession
    packed.write.mode("overwrite").parquet(f"{path}/packed")
    _write_meta(spark, {**{"method": "turbo-lloyd", "source_model": ""}, **meta}, f"{path}/meta")
    return path


def load_packed(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Read a packed export. Legacy: a scalar ``codebook_val`` v means [-v, v];
    bits default to 1, method to 'turbo-lloyd', source to ''."""
    meta = _read_meta(spark, f"{path}/meta")
    if meta.get("codebook") is None and meta.get("codebook_val") is not None:
        v = float(meta["codebook_val"])
        meta["codebook"] = [-v, v]
    meta.setdefault("bits", 1)
    if meta.get("bits") is None:
        meta["bits"] = 1
    meta["method"] = meta.get("method") or "turbo-lloyd"
    meta["source_model"] = meta.get("source_model") or ""
    return spark.read.parquet(f"{path}/packed"), meta


def packed_info(packed: DataFrame, meta: dict) -> DataFrame:
    """One row: source, tokenizer, vocab size, dim, bits, method, logical MB.

    vocab size is counted from the packed table itself."""
    d, bits = int(meta["embed_dim"]), int(meta["bits"])
    n = F.count(F.lit(1))
    logical = F.floor((n * d * bits + 7) / 8) + n * 4
    return packed.agg(
        F.lit(meta.get("source_model", "")).alias("source_model"),
        F.lit(meta.get("tokenizer_name", "")).alias("tokenizer_name"),
        n.cast("bigint").alias("vocab_size"), F.lit(d).alias("embed_dim"),
        F.lit(bits).alias("bits"), F.lit(meta.get("method", "")).alias("method"),
        F.round(logical / 1e6, 6).alias("logical_size_mb"))
