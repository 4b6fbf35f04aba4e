"""Relevance judgments and retrieval metrics (nDCG@k, recall@k) per query and group.

Judgments come in two forms:
  * explicit qrels (qid, docid, rel)
  * an attribute rule: a passage is relevant (rel 1) to a query when the two
    agree on every key column (e.g. same lang and source). The pairs are never
    materialised: the number of relevant passages is a group count joined to
    the queries, and a retrieved passage is labelled by joining its keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_bounded

METRIC_DIGITS = 6
KEY_BYTES = 256         # of a broadcast row of keys


@dataclass
class Judgments:
    """``by`` names the columns that tell queries (and passages) of one id apart, e.g. the
    language; all tables of the judgments have them."""

    qrels: DataFrame | None = None            # (*by, qid, docid, rel)
    query_keys: DataFrame | None = None       # (*by, qid, *keys)
    doc_keys: DataFrame | None = None         # (*by, docid, *keys)
    keys: tuple[str, ...] = ()
    by: tuple[str, ...] = ()

    @property
    def explicit(self) -> bool:
        return self.qrels is not None

    @property
    def query(self) -> list[str]:
        return ["qid", *self.by]

    @property
    def doc(self) -> list[str]:
        return ["docid", *self.by]


def _unique(*names: str) -> list[str]:
    return list(dict.fromkeys(names))


def judged_queries(queries: DataFrame, j: Judgments) -> DataFrame:
    """Queries that have at least one judgment."""
    if j.explicit:
        return queries.join(j.qrels.select(*j.query).distinct(), j.query, "left_semi")
    on = _unique(*j.by, *j.keys)
    present = j.doc_keys.select(*on).distinct()
    judged = j.query_keys.join(present, on, "left_semi").select(*j.query)
    return queries.join(judged, j.query, "left_semi")


def num_relevant(j: Judgments) -> DataFrame:
    """(qid, *by, num_relevant): judgments with rel > 0 per query."""
    if j.explicit:
        return j.qrels.groupBy(*j.query).agg(
            F.count(F.when(F.col("rel") > 0, 1)).cast("bigint").alias("num_relevant"))
    on = _unique(*j.by, *j.keys)
    per_key = j.doc_keys.groupBy(*on).agg(F.count(F.lit(1)).alias("num_relevant"))
    return j.query_keys.join(per_key, on).select(*j.query, "num_relevant")


def ranked_rels(ranked: DataFrame, j: Judgments) -> DataFrame:
    """ranked (qid, *by, docid, rank, ...) + rel; unjudged documents get 0.

    By rule: the query's keys are joined to the ranked rows, then passages that have the same
    id and keys. The ranked list is read once, since all of the ranking hangs on it.
    """
    pair = _unique(*j.query, "docid")
    if j.explicit:
        rels = j.qrels.select(*pair, F.col("rel").cast("int").alias("rel"))
        return ranked.join(rels, pair, "left").withColumn("rel", F.coalesce(F.col("rel"), F.lit(0)))
    extra = [k for k in j.keys if k not in j.by]
    asked = ranked.join(j.query_keys.select(*j.query, *[F.col(k).alias(f"_q_{k}") for k in extra]), j.query, "left")
    same = j.doc_keys.select(*j.doc, *[F.col(k).alias(f"_q_{k}") for k in extra], F.lit(1).alias("rel"))
    labelled = asked.join(same, [*j.doc, *[f"_q_{k}" for k in extra]], "left")
    return labelled.select(*ranked.columns, F.coalesce("rel", F.lit(0)).alias("rel"))


def pooled_docids(j: Judgments) -> DataFrame:
    """docids named by any judgment (explicit form) - the pooled set's keys."""
    return j.qrels.select(*j.doc).distinct()


def pool(passages: DataFrame, j: Judgments) -> DataFrame:
    """Passages that occur in any judgment."""
    if j.explicit:
        return passages.join(pooled_docids(j), j.doc, "left_semi")
    on = _unique(*j.by, *j.keys)
    asked = j.query_keys.select(*on).distinct()
    if set(on) <= set(passages.columns):        # the passages carry the keys themselves
        return passages.join(broadcast_if_bounded(asked, KEY_BYTES)[0], on, "left_semi")
    return passages.join(j.doc_keys.join(asked, on, "left_semi").select(*j.doc), j.doc, "left_semi")


def per_query_metrics(labelled: DataFrame, ks_ndcg=(10,), ks_recall=(10,), query=("qid",)) -> DataFrame:
    """Per query: DCG-based nDCG@k (ideal = retrieved list re-sorted by rel) and hits@k."""
    w = Window.partitionBy(*query).orderBy(F.desc("rel"), F.asc("rank"))
    lab = labelled.withColumn("irank", F.row_number().over(w))
    rank, irank, rel = F.col("rank"), F.col("irank"), F.col("rel").cast("double")
    aggs = []
    for k in ks_ndcg:
        aggs.append(F.sum(F.when(rank <= k, rel / F.log2(rank + 1))).alias(f"_dcg{k}"))
        aggs.append(F.sum(F.when(irank <= k, rel / F.log2(irank + 1))).alias(f"_idcg{k}"))
    for k in ks_recall:
        aggs.append(F.count(F.when((rank <= k) & (F.col("rel") > 0), 1)).alias(f"_hit{k}"))
    return lab.groupBy(*query).agg(*aggs)


def qrels_ideal(j: Judgments, ks=(10,)) -> DataFrame:
    """(qid, *by, _idcg{k}): the textbook ideal DCG from all judgments of the query
    (explicit qrels), the best k labels in descending order."""
    w = Window.partitionBy(*j.query).orderBy(F.desc("rel"), F.asc("docid"))
    r = j.qrels.where(F.col("rel") > 0).withColumn("_r", F.row_number().over(w))
    return r.groupBy(*j.query).agg(*[F.sum(F.when(F.col("_r") <= k, F.col("rel") / F.log2(F.col("_r") + 1)))
                                     .alias(f"_idcg{k}") for k in ks])


def query_scores(queries: DataFrame, ranked: DataFrame, j: Judgments, ks_ndcg=(10,), ks_recall=(10,),
                 group_cols=(), ideal: str = "retrieved", models: list[str] | None = None) -> DataFrame:
    """One row per judged query: ndcg_{k}, recall_{k}, num_relevant, skipped flag.

    ``ideal='retrieved'`` (default) takes the ideal DCG from the retrieved list
    re-sorted by label, so missing relevant documents do not lower nDCG;
    ``ideal='qrels'`` is the textbook form over all judged documents. With ``models``
    the ranked list has a column ``model``, and every query a row for each of them.
    """
    jq = judged_queries(queries.select(*_unique("qid", *group_cols, *j.by)), j)
    query = j.query
    if models is not None:
        jq = jq.withColumn("model", F.explode(F.array(*map(F.lit, models))))
        query = [*query, "model"]
    pq = per_query_metrics(ranked_rels(ranked, j), ks_ndcg, ks_recall, query)
    if ideal == "qrels":
        if not j.explicit:
            raise ValueError("ideal='qrels' needs explicit qrels")
        pq = pq.drop(*[f"_idcg{k}" for k in ks_ndcg]).join(qrels_ideal(j, ks_ndcg), j.query, "left")
    elif ideal != "retrieved":
        raise ValueError(f"unknown ideal {ideal!r}")
    base = jq.join(num_relevant(j), j.query, "left").join(pq, query, "left") \
             .withColumn("num_relevant", F.coalesce(F.col("num_relevant"), F.lit(0)))
    out = [*_unique(*query, *group_cols), F.col("num_relevant"), (F.col("num_relevant") == 0).alias("skipped")]
    for k in ks_ndcg:
        idcg = F.coalesce(F.col(f"_idcg{k}"), F.lit(0.0))
        out.append(F.when(idcg > 0, F.col(f"_dcg{k}") / idcg).otherwise(0.0).alias(f"ndcg_{k}"))
    for k in ks_recall:
        out.append(F.when(F.col("num_relevant") > 0,
                          F.coalesce(F.col(f"_hit{k}"), F.lit(0)) / F.col("num_relevant"))
                   .otherwise(0.0).alias(f"recall_{k}"))
    return base.select(*out)


def summarise(scores: DataFrame, group_cols=(), ks_ndcg=(10,), ks_recall=(10,),
              groups: DataFrame | None = None, digits: int | None = METRIC_DIGITS) -> DataFrame:
    """Mean of each metric over non-skipped queries, num_queries, skipped.

    With ``groups`` (a table of group keys) every listed group gets a row, all
    zeros when it has no scored query. ``digits`` None keeps the means unrounded,
    for tables from which others are computed.
    """
    ok = ~F.col("skipped")
    aggs = []
    for k in ks_ndcg:
        aggs.append(F.avg(F.when(ok, F.col(f"ndcg_{k}"))).alias(f"ndcg_{k}"))
    for k in ks_recall:
        aggs.append(F.avg(F.when(ok, F.col(f"recall_{k}"))).alias(f"recall_{k}"))
    aggs.append(F.count(F.when(ok, 1)).alias("num_queries"))
    aggs.append(F.count(F.when(F.col("skipped"), 1)).alias("skipped"))
    s = scores.groupBy(*group_cols).agg(*aggs)
    if groups is not None:
        s = groups.select(*group_cols).distinct().join(s, list(group_cols), "left")
    metric_cols = [f"ndcg_{k}" for k in ks_ndcg] + [f"recall_{k}" for k in ks_recall]
    shown = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return s.select(*group_cols,
                    *[shown(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in metric_cols],
                    F.coalesce(F.col("num_queries"), F.lit(0)).cast("bigint").alias("num_queries"),
                    F.coalesce(F.col("skipped"), F.lit(0)).cast("bigint").alias("skipped"))


def dcg_at_k(labelled: DataFrame, k: int) -> DataFrame:
    return labelled.groupBy("qid").agg(
        F.round(F.coalesce(F.sum(F.when(F.col("rank") <= k,
                                        F.col("rel") / F.log2(F.col("rank") + 1))),
                           F.lit(0.0)), METRIC_DIGITS).alias(f"dcg_{k}"))
