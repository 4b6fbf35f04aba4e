"""Session helpers: building a local session for tests/bench, and finding the
shared folder for lineage cuts and scratch output."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "vectorloom") -> SparkSession:
    """A local session with the settings the library expects (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.codegen.maxFields", "2000")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this setting names shared storage and is only read; without it
    the call fails, as executors could not see a folder of the driver's own disk.
    With a local master (tests) a fresh folder under the system temp dir is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir must name shared storage when the master is {master}")
        path = tempfile.mkdtemp(prefix="vectorloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vectorloom/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    Used between iterations and pipeline steps: the written table survives
    executor loss (unlike a local checkpoint) and ends the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_MATERIALIZED: dict[tuple, tuple[str, StructType]] = {}


def materialize(df_builder, key: tuple, spark: SparkSession, name: str = "table",
                data: Sequence[str] = ()) -> DataFrame:
    """Build a derived table once per process, key and state of the ``data`` paths, write it
    to the shared checkpoint folder, and read it back (later calls reuse the written table).

    For artifacts that several plans read (a vocabulary, derived judgments):
    they are computed by one job instead of being recomputed inside each plan.
    When a file of ``data`` changes, the table is built anew.
    """
    from .sources.store import fingerprint
    full_key = (ensure_checkpoint_dir(spark), fingerprint(spark, *data)) + tuple(key)
    if full_key not in _MATERIALIZED:
        path, built = scratch_path(spark, name), df_builder()
        built.write.mode("overwrite").parquet(path)
        _MATERIALIZED[full_key] = path, built.schema
    path, schema = _MATERIALIZED[full_key]
    return spark.read.schema(schema).parquet(path)       # known, so that no job looks for it
