"""Tables on shared storage: what data a folder holds, and folders that are whole or absent.

Everything goes through the Hadoop file system of the path, so it works for any storage that
Spark's readers can open; nothing looks at a driver's own disk.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of all files below ``path`` (a folder, file or glob), sorted."""
    fs, at = _file_system(spark, path)
    out = []
    for top in fs.globStatus(at) or []:
        found = fs.listFiles(top.getPath(), True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes when a file below the paths is added, removed, resized or written again."""
    seen = [[p, files(spark, p)] for p in paths]
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:20]


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small text file at ``path``, replacing one that is there."""
    fs, at = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, partition_by: str | None = None) -> str:
    """Writes the tables to ``path/<name>`` as one: aside first, then moved by one rename.

    A reader sees all tables or none. If ``path`` is there already, or another writer is
    first, what is there stays and this copy is removed. ``partition_by`` applies to the
    tables that have the column.
    """
    if exists(spark, path):
        return path
    parent, _, name = path.rstrip("/").rpartition("/")
    aside = f"{parent}/_writing-{name}-{uuid.uuid4().hex[:12]}"
    for table, df in tables.items():
        w = df.write
        if partition_by in df.columns:
            w = w.partitionBy(partition_by)
        w.parquet(f"{aside}/{table}")
    fs, at = _file_system(spark, aside)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(at, spark._jvm.org.apache.hadoop.fs.Path(path), plain)   # fails if path is there
    except Exception:
        if not exists(spark, path):
            raise
        fs.delete(at, True)
    return path
