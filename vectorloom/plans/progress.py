"""Evaluations that take up where they stopped: a commit log of (model, language).

Each pair that is scored becomes a folder of its own under the log, written aside and moved
into place, with its metrics and its wall-clock seconds. A run reads the log, scores what is
missing and commits it pair by pair; one that dies loses at most the pair it was at.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

KEYS = ("model", "lang")


def _entry(log: str, model: str, lang: str) -> str:
    return f"{log.rstrip('/')}/{hashlib.sha256(repr((model, lang)).encode()).hexdigest()[:24]}"


def committed(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """(model, lang, metrics, seconds) of every pair in the log; ``schema`` names the metrics."""
    entries = f"{log.rstrip('/')}/[0-9a-f]*/scores"          # not what is being written aside
    full = f"model string, lang string, {schema}, seconds double"
    if not store.files(spark, entries):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(entries)


def todo(requested: DataFrame, log: DataFrame, keys=KEYS) -> DataFrame:
    """Requested pairs that the log does not have."""
    return requested.join(log.select(*keys), list(keys), "left_anti")


def resume(spark: SparkSession, log: str, requested: DataFrame, schema: str,
           score: Callable[[str, str], DataFrame], at_most: int | None = None) -> DataFrame:
    """Scores the requested pairs that are not in the log, in order, and returns the log.

    ``score(model, lang)`` gives one row of metrics. The pairs (models x languages) are few
    and come to the driver; each is scored by Spark jobs of its own. A pair whose files are
    missing (FileNotFoundError) is passed over, to be tried again by the next run.
    ``at_most`` stops after so many pairs.
    """
    left = todo(requested, committed(spark, log, schema)).orderBy(*KEYS).collect()
    for model, lang in [(r["model"], r["lang"]) for r in left][:at_most]:
        began = time.perf_counter()
        try:
            row = score(model, lang).first()
        except FileNotFoundError:
            continue
        cells = [model, lang, *row, time.perf_counter() - began]
        done = spark.createDataFrame([cells], f"model string, lang string, {schema}, seconds double")
        store.publish(spark, {"scores": done}, _entry(log, model, lang))
    return committed(spark, log, schema)
