"""The queries of the numbered operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, embedding_dedup, hard_negatives, jaccard_join, kneser_ney, language_id, line_dedup, packing, secret_scan,
               source_divergence, stupid_backoff, substring_dedup, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stupid_backoff.score_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


def op1_stupid_backoff_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stupid_backoff.score_documents(_table(spark, sf_dir, "documents"), order=3)
    return out.select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    return records.withColumn("block", F.col("block").cast("string"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passage_report(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_documents(_table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted",
                      F.length("text").cast("bigint").alias("chars_left"),
                      F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(*language_id.training_sample(docs))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_table(spark, sf_dir, "documents"))
    named = lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])
    base = F.filter("findings", lambda f: f["via"] == "")
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, secret_scan.KINDS),
                      F.sha2(F.array_join(F.transform(base, named), ",").cast("binary"), 256).alias("base_sha256"),
                      F.array_join(F.array_distinct(F.transform("findings", named)), ",").alias("spans"),
                      "n_layers", "n_unopened")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_stupid_backoff, op1_stupid_backoff_trigrams, op2_decontamination, op3_jaccard_join,
                            op4_warc_derivatives, op5_embedding_dedup, op6_substring_dedup, op7_packing,
                            op8_line_dedup, op9_quality, op10_language_id, op11_secret_scan,
                            op12_hard_negatives, op13_source_divergence)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_stupid_backoff": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws
           FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT t.r, t.i, t.w, lag(t.w) OVER (PARTITION BY t.r ORDER BY t.i) AS v FROM t),
c1 AS (SELECT w, count(*) AS n FROM b GROUP BY w),
o1 AS (SELECT r, w, count(*) AS n FROM b GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT r, v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY r, v, w),
s AS (SELECT b.r, CASE
        WHEN b.v IS NOT NULL AND c2.n - o2.n > 0 THEN ln((c2.n - o2.n) / (cv.n - ov.n))
        WHEN c1.n - o1.n > 0 THEN ln((c1.n - o1.n) / greatest((SELECT count(*) FROM t) - len(d.ws), 1))
                                  + CASE WHEN b.v IS NULL THEN 0 ELSE ln(0.4) END
        ELSE ln(0.4 / greatest((SELECT count(*) FROM t) - len(d.ws), 1)) + CASE WHEN b.v IS NULL THEN 0 ELSE ln(0.4) END
      END AS x
      FROM b JOIN d ON d.r = b.r JOIN c1 ON c1.w = b.w JOIN o1 ON o1.r = b.r AND o1.w = b.w
      LEFT JOIN c1 cv ON cv.w = b.v LEFT JOIN o1 ov ON ov.r = b.r AND ov.w = b.v
      LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN o2 ON o2.r = b.r AND o2.v = b.v AND o2.w = b.w),
m AS (SELECT r, avg(x) AS x FROM s GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, round(m.x, 6) AS mean_log_score
FROM d LEFT JOIN m ON m.r = d.r""",
    "op1_stupid_backoff_trigrams": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws
           FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT r, i, w, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM t WINDOW p AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM b GROUP BY w),
o1 AS (SELECT r, w, count(*) AS n FROM b GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT r, v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY r, v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM b WHERE u IS NOT NULL GROUP BY u, v, w),
o3 AS (SELECT r, u, v, w, count(*) AS n FROM b WHERE u IS NOT NULL GROUP BY r, u, v, w),
s AS (SELECT b.r, CASE
        WHEN b.u IS NOT NULL AND c3.n - o3.n > 0 THEN ln((c3.n - o3.n) / (cu.n - ou.n))
        WHEN b.v IS NOT NULL AND c2.n - o2.n > 0 THEN ln((c2.n - o2.n) / (cv.n - ov.n))
                                  + CASE WHEN b.u IS NULL THEN 0 ELSE ln(0.4) END
        ELSE CASE WHEN c1.n - o1.n > 0 THEN ln((c1.n - o1.n) / greatest((SELECT count(*) FROM t) - len(d.ws), 1))
                  ELSE ln(0.4 / greatest((SELECT count(*) FROM t) - len(d.ws), 1)) END
             + CASE WHEN b.v IS NULL THEN 0 WHEN b.u IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END
      END AS x
      FROM b JOIN d ON d.r = b.r JOIN c1 ON c1.w = b.w JOIN o1 ON o1.r = b.r AND o1.w = b.w
      LEFT JOIN c1 cv ON cv.w = b.v LEFT JOIN o1 ov ON ov.r = b.r AND ov.w = b.v
      LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN o2 ON o2.r = b.r AND o2.v = b.v AND o2.w = b.w
      LEFT JOIN c2 cu ON cu.v = b.u AND cu.w = b.v LEFT JOIN o2 ou ON ou.r = b.r AND ou.v = b.u AND ou.w = b.v
      LEFT JOIN c3 ON c3.u = b.u AND c3.v = b.v AND c3.w = b.w
      LEFT JOIN o3 ON o3.r = b.r AND o3.u = b.u AND o3.v = b.v AND o3.w = b.w),
m AS (SELECT r, avg(x) AS x FROM s GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, round(m.x, 6) AS mean_log_score
FROM d LEFT JOIN m ON m.r = d.r""",
    "op12_hard_negatives": """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
             CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM r a JOIN r ON a.id % 50 = 0 AND r.id <> a.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id
       ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
     AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op13_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS ng
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.ng + 2 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.total + 2)) // (l.nl + 2 * l.v) AS q
      FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 10""",
}
