"""Registered queries: the Structured Streaming corpus pass.

``documents`` are written as gzip JSON-lines shards, then consumed as a stream in
micro-batches. The streamed
results must equal the batch ones, so the checks reuse the batch SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import quantize as Q
from ..session import scratch_path
from ..sources import store
from ..sources import testdata as T
from ..streaming import corpus as S
from ..operators.text import encode, estimated_bytes
from .registry import (_model_and_vocab, _ranked_out, _sql_encode, _sql_nearest, _sql_topk_full, _sql_turbo,
                       base, register)
from . import oracle as O

SHARDS = 8                      # at least; a shard is one task until it is dealt out
SHARD_BYTES = 32 * 1024 * 1024
STREAM_GLOB = "part-*.json.gz"


def _write_shards(docs, spark, shards: int | None) -> str:
    path = scratch_path(spark, "stream-corpus")
    (docs.select(F.col("docid").cast("string").alias("docid"), F.lit(None).cast("string").alias("title"), "text")
     .repartition(shards or max(SHARDS, estimated_bytes(docs) // SHARD_BYTES)).write.mode("overwrite").option("compression", "gzip").json(path))
    return path


def write_stream_corpus(spark, sf, shards: int | None = None) -> str:
    """All documents as shards."""
    return _write_shards(T.passages(spark, sf), spark, shards)


def write_stream_passages(spark, sf, shards: int | None = None) -> str:
    """The passages of the ranked queries (topics B are documents themselves and stay out)."""
    return _write_shards(T.passages_b(spark, sf), spark, shards)


def _stream(spark, path, files_per_batch: int | None = None):
    """The shards of ``path`` in about four batches."""
    if files_per_batch is None:
        files_per_batch = max(2, len([f for f, *_ in store.files(spark, path) if f.endswith(".gz")]) // 4)
    return S.stream_corpus(spark, path, glob=STREAM_GLOB, files_per_batch=files_per_batch, id_type="bigint")


@register("stream_corpus", "SELECT text_id AS docid, coalesce(text, '') AS text FROM (" + O.DOCS + ")")
def q_stream_corpus(spark, sf):
    out = scratch_path(spark, "stream-raw")
    S._run(_stream(spark, write_stream_corpus(spark, sf)).writeStream.format("parquet").option("path", out),
           scratch_path(spark, "ckpt-raw"))
    return spark.read.parquet(out)


@register("stream_encode", _sql_encode("turbo-lloyd-1", O.DOCS))
def q_stream_encode(spark, sf):
    m, v = _model_and_vocab(spark, sf)
    enc, _ = S.stream_encode(_stream(spark, write_stream_corpus(spark, sf)), m, v, scratch_path(spark, "stream-enc"),
                             scratch_path(spark, "ckpt-enc"))
    return V.long_form(enc.withColumnRenamed("docid", "text_id"), "text_id", "embedding")


def _topic_vectors(spark, sf, m, v):
    return encode(T.topics_b(spark, sf).select(F.col("qid").alias("text_id"), "text"), m, v) \
        .withColumnRenamed("text_id", "qid")


@register("stream_topk", _sql_topk_full)
def q_stream_topk(spark, sf):
    m, v = _model_and_vocab(spark, sf)
    top, _ = S.stream_topk(_stream(spark, write_stream_passages(spark, sf)), _topic_vectors(spark, sf, m, v), m, v, 100,
                           scratch_path(spark, "ckpt-topk"))
    return _ranked_out(top)


PROGRESS_FILES = 12


@register("stream_progress", (
    f"SELECT r.i AS batch_id, (SELECT count(*) FROM documents) AS passages, {PROGRESS_FILES}::BIGINT AS batches "
    f"FROM (SELECT range::BIGINT AS i FROM range({PROGRESS_FILES})) r"))
def q_stream_progress(spark, sf):
    """Progress of a pass over all documents, a shard a batch: every batch, and the passages that
    all of them report together (the figures of a single batch follow how shards fall)."""
    folder = scratch_path(spark, "stream-progress")
    m, v = _model_and_vocab(spark, sf)
    q = T.vector_queries(spark, sf).select("qid", "embedding")
    shards = _stream(spark, write_stream_corpus(spark, sf, PROGRESS_FILES), 1)
    dealt = shards.repartition(spark.sparkContext.defaultParallelism)       # a shard alone would be one task
    S.stream_topk(dealt, q, m, v, 10, scratch_path(spark, "ckpt-progress"), folder)
    rows = S.progress_rows(spark, folder)
    whole = rows.agg(F.max("total_rows").alias("passages"), F.count(F.lit(1)).alias("batches"))
    return rows.select("batch_id", F.lit(1).alias("k")).join(whole.withColumn("k", F.lit(1)), "k").drop("k")


@register("stream_quantize", _sql_turbo(2))
def q_stream_quantize(spark, sf):
    m = base(spark, sf)
    src = scratch_path(spark, "stream-vectors")
    m.weights.repartition(4).write.mode("overwrite").parquet(src)

    def quantizer(df):
        return Q.codebook_codes_df(Q.rotate_hadamard(df, m.dim), m.dim, 2)

    out = S.stream_quantize(spark, src, "row_id bigint, embedding array<double>", quantizer,
                            scratch_path(spark, "stream-q"), scratch_path(spark, "ckpt-q"))
    from .registry import codes_long
    return codes_long(out)


@register("stream_nearest", _sql_nearest)
def q_stream_nearest(spark, sf):
    """nearest_rows over a stream of vectors, merged by a stateful operator."""
    from ..operators import tables as TB
    from ..streaming.stateful import stream_nearest
    m = base(spark, sf)
    src = scratch_path(spark, "vector-stream")
    TB.l2_normalise(T.vector_rows(spark, sf).select("docid", "embedding"), m.dim) \
        .repartition(4).write.mode("overwrite").parquet(src)
    rows = spark.readStream.schema("docid bigint, embedding array<double>") \
        .option("maxFilesPerTrigger", 1).parquet(src)
    q = TB.l2_normalise(T.vector_queries(spark, sf).select("qid", "embedding"), m.dim)
    top, _ = stream_nearest(rows, q, 10, m.dim, scratch_path(spark, "nearest-log"),
                            scratch_path(spark, "ckpt-nearest"))
    return _ranked_out(top)
