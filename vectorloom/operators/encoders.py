"""User encoders: any ``list[str] -> (n, D) array`` function as an Arrow batch job.

The built-in encoder is the DataFrame plan in ``text.encode``. This hook runs a
user function over Arrow batches of a partition (``mapInArrow``), e.g. a model
served in-process; Spark partitions the texts and the output joins and ranks
like any other vectors.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

def word_hash(w: str) -> int:
    """Position-weighted sum of code points: sum_i (i + 1) * ord(w[i])."""
    return sum((i + 1) * ord(ch) for i, ch in enumerate(w))


def hashing_encoder(d: int):
    """Example user encoder: signed feature hashing of lower-cased words
    (runs of letters and digits), L2-normalised. Bucket h % d, sign + when
    (h // d) is even."""
    try:
        import regex as rx
        words = rx.compile(r"[\p{L}\p{N}]+")
    except ImportError:             # the stdlib class is close: letters and digits
        import re as rx
        words = rx.compile(r"[^\W_]+")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), d))
        for i, t in enumerate(texts):
            for w in words.findall((t or "").lower()):
                h = word_hash(w)
                out[i, h % d] += 1.0 if (h // d) % 2 == 0 else -1.0
        n = np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-8)
        return out / n
    return encode


def map_encoder(texts: DataFrame, fn, d: int, key: str = "text_id", text: str = "text") -> DataFrame:
    """(key, embedding array<double>) from ``fn`` applied to each Arrow batch."""
    def run(batches):
        for rb in batches:
            if rb.num_rows == 0:
                continue
            vals = rb.column(text).to_pylist()
            m = np.asarray(fn(vals), dtype=np.float64).reshape(len(vals), d)
            offs = pa.array(np.arange(0, (len(vals) + 1) * d, d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [rb.column(key), pa.ListArray.from_arrays(offs, pa.array(m.reshape(-1)))],
                names=[key, "embedding"])
    src = texts.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text))
    return src.mapInArrow(run, f"{key} bigint, embedding array<double>")
