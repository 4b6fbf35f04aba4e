"""Registered queries: file sources and sinks (TREC topics / qrels, JSON-lines
corpora, model and packed tables). Each writes a file set derived from the
driver's tables to a new folder under the shared checkpoint folder, then reads
it back with the operator under test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import scratch_path
from ..sources import models as MD
from ..sources import testdata as T
from ..sources import trec as TR
from . import oracle as O
from .registry import recipe, register

FILES = 4


def _clean(c):
    return F.regexp_replace(c, r"[\t\r\n]", " ")


def _write_lines(df: DataFrame, path: str) -> str:
    """Write (k, seq, line) as text, ordered by (k, seq) across range-partitioned files."""
    (df.repartitionByRange(FILES, "k", "seq").sortWithinPartitions("k", "seq")
       .select("line").write.mode("overwrite").text(path))
    return path


def write_topics(spark: SparkSession, sf: str) -> str:
    """benchmark -> topics TSV with blank lines and an earlier, overridden duplicate."""
    b = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("k"), _clean(F.col("text")).alias("t"))
    final = b.select("k", F.lit(2).alias("seq"), F.concat_ws("\t", F.col("k").cast("string"), "t").alias("line"))
    dup = b.where(F.col("k") % 3 == 0).select("k", F.lit(0).alias("seq"),
                                              F.concat_ws("\t", F.col("k").cast("string"), F.lit("stale")).alias("line"))
    blank = b.where(F.col("k") % 4 == 0).select("k", F.lit(1).alias("seq"), F.lit("  ").alias("line"))
    return _write_lines(final.unionByName(dup).unionByName(blank), scratch_path(spark, "topics"))


def write_qrels(spark: SparkSession, sf: str) -> str:
    """qrels A -> TREC TSV, with 3-field junk lines and earlier rel-0 duplicates."""
    q = T.qrels_a(spark, sf).select(F.col("qid").alias("k"), "docid", "rel")
    line = lambda rel: F.concat_ws("\t", F.col("k").cast("string"), F.lit("Q0"),
                                   F.col("docid").cast("string"), rel)
    final = q.select("k", F.lit(2).alias("seq"), line(F.col("rel").cast("string")).alias("line"))
    dup = q.where(F.col("docid") % 2 == 0).select("k", F.lit(0).alias("seq"), line(F.lit("0")).alias("line"))
    junk = q.select("k", F.lit(1).alias("seq"),
                    F.concat_ws("\t", F.col("k").cast("string"), F.lit("Q0"), F.col("docid").cast("string")).alias("line"))
    return _write_lines(final.unionByName(dup).unionByName(junk), scratch_path(spark, "qrels"))


def write_corpus(spark: SparkSession, sf: str) -> str:
    """documents -> gzip JSON lines (docid, title = source, null every 5th, text)."""
    d = T.table(spark, sf, "documents")
    path = scratch_path(spark, "corpus")
    (d.select(F.col("doc_id").cast("string").alias("docid"),
              F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("source")).alias("title"),
              "text")
      .repartition(FILES).write.mode("overwrite").option("compression", "gzip").json(path))
    return path


CORPUS_GLOB = "part-*.json.gz"

SQL_PASSAGE = ("SELECT doc_id::VARCHAR AS docid, CASE WHEN coalesce(t, '') <> '' THEN t || '. ' || coalesce(text, '') "
               "ELSE coalesce(text, '') END AS text FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN NULL "
               "ELSE source END AS t FROM documents)")


@register("read_topics", "SELECT item_id::VARCHAR AS qid, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS text FROM benchmark")
def q_read_topics(spark, sf):
    return TR.read_topics(spark, write_topics(spark, sf))


@register("read_qrels", "SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rel FROM (" + O.QRELS_A + ")")
def q_read_qrels(spark, sf):
    return TR.read_qrels(spark, write_qrels(spark, sf))


def _corpus(spark, sf):
    return TR.read_corpus(spark, write_corpus(spark, sf), glob=CORPUS_GLOB)


@register("read_corpus", SQL_PASSAGE)
def q_read_corpus(spark, sf):
    return _corpus(spark, sf).select("docid", "text")


@register("format_passage", SQL_PASSAGE)
def q_format_passage(spark, sf):
    title = F.when(F.col("doc_id") % 5 != 0, F.col("source"))       # a fifth has no title
    return T.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("docid"),
                                                  TR.format_passage(title, F.col("text")).alias("text"))


@register("pooled_passages", "SELECT docid, text FROM (" + SQL_PASSAGE + ") WHERE docid IN "
                             "(SELECT docid::VARCHAR FROM (" + O.QRELS_A + "))")
def q_pooled_passages(spark, sf):
    qrels = TR.read_qrels(spark, write_qrels(spark, sf))
    found, _ = TR.pooled_passages(_corpus(spark, sf), qrels)
    return found


@register("load_eval_set",
          "SELECT 'topic' AS part, item_id::VARCHAR AS id, '' AS other, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS value "
          "FROM benchmark WHERE item_id IN (SELECT qid FROM (" + O.QRELS_A + ")) UNION ALL "
          "SELECT 'qrel', qid::VARCHAR, docid::VARCHAR, rel::VARCHAR FROM (" + O.QRELS_A + ") UNION ALL "
          "SELECT 'passage', docid, '', text FROM (" + SQL_PASSAGE + ") WHERE docid IN (SELECT docid::VARCHAR FROM ("
          + O.QRELS_A + "))")
def q_load_eval_set(spark, sf):
    """Judged topics, qrels and pooled passages of the set, one under the other."""
    topics, qrels, passages = TR.load_eval_set(spark, write_topics(spark, sf), write_qrels(spark, sf),
                                               write_corpus(spark, sf), glob=CORPUS_GLOB)
    rows = lambda df, part, id_, other, value: df.select(F.lit(part).alias("part"), F.col(id_).alias("id"),
                                                         other.alias("other"), value.alias("value"))
    return (rows(topics, "topic", "qid", F.lit(""), F.col("text"))
            .unionByName(rows(qrels, "qrel", "qid", F.col("docid"), F.col("rel").cast("string")))
            .unionByName(rows(passages, "passage", "docid", F.lit(""), F.col("text"))))


def _sql_model_roundtrip():
    s = O.Sql()
    c = s.codebook_codes(2, s.hadamard(), "tl2")
    return s.build(f"SELECT row_id, dim, code, round(scale, 6) AS scale FROM {c}")


@register("save_model", _sql_model_roundtrip)
def q_save_model(spark, sf):
    m = recipe(spark, sf, "turbo-lloyd-2")
    path = MD.save_model(m, scratch_path(spark, "models"))
    back = MD.load_model(spark, path)
    from .registry import codes_long
    return codes_long(back.weights)


@register("load_packed", None)
def q_load_packed(spark, sf):
    packed, meta = MD.export_packed(recipe(spark, sf, "int4"))
    path = MD.save_packed(packed, meta, scratch_path(spark, "export"))
    p2, m2 = MD.load_packed(spark, path)
    return V.long_form(MD.decode_packed(p2, m2), "row_id", "embedding")


@register("packed_info",
          "SELECT 'embeddings' AS source_model, 'words' AS tokenizer_name, count(*)::BIGINT AS vocab_size, "
          "64 AS embed_dim, 1 AS bits, 'turbo-lloyd' AS method, "
          "round(((count(*) * 64 * 1 + 7) // 8 + count(*) * 4) / 1e6, 6) AS logical_size_mb FROM embeddings")
def q_packed_info(spark, sf):
    packed, meta = MD.export_packed(recipe(spark, sf, "turbo-lloyd-1"))
    return MD.packed_info(packed, meta)


def _sql_load_packed():
    s = O.Sql()
    return s.build(f"SELECT row_id, dim, round(x, 6) AS value FROM {s.model('int4')}")


from .registry import SQL as _SQL  # noqa: E402
_SQL["load_packed"] = _sql_load_packed
