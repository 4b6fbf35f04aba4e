"""Registered queries: reporting across models and languages, and task scores.

The model grid evaluates several recipes (pooled retrieval, topics B, per
language) in Spark and is written once per data folder; the report queries
read that table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators import reports as RP
from ..operators import tasks as TK
from ..operators.text import encode
from ..session import cut_lineage, materialize, scratch_path
from ..sources import testdata as T
from ..operators import relevance as M
from . import evaluation as E
from . import oracle as O
from . import progress as PR
from .registry import (SIZE_RECIPES, _size_sql_expr, _size_spark, base, model_artifact, recipe,
                       register, vocab)

# Fixed configuration: the recipes of the grid and the base model; languages come from the data.
GRID = ("baseline", "int8", "int4", "turbo-lloyd-1", "turbo-lloyd-2")
BASE = "embeddings"
METRICS = ["ndcg_10", "recall_10", "recall_3"]
RESUMED = ("baseline", "turbo-lloyd-1")      # the models of the resumed run
FULL = "ndcg_10 double, recall_100 double, num_queries bigint, skipped bigint, total_passages bigint"


def model_name(r: str) -> str:
    return BASE if r == "baseline" else f"{BASE}_{r}"


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def _grid_plan(spark, sf) -> DataFrame:
    models = {model_name(r): model_artifact(spark, sf, r) for r in GRID}
    return E.eval_models(models, vocab(spark, sf, base(spark, sf)), T.topics_b(spark, sf), T.passages_b(spark, sf),
                         T.judgments_b(spark, sf), group_cols=("lang",))


def grid(spark, sf) -> DataFrame:
    """(model, lang, ndcg_10, recall_10, recall_3, num_queries, skipped), metrics unrounded."""
    return materialize(lambda: _grid_plan(spark, sf), ("grid", sf), spark, "grid",
                       T.paths(sf, "documents", "embeddings"))


def sizes(spark, sf) -> DataFrame:
    """(model, size_mb, provenance) of the grid's models."""
    m0 = base(spark, sf)
    parts = []
    for r in GRID:
        m = recipe(spark, sf, r, m0)
        steps = F.array(*map(F.lit, m.provenance))
        parts.append(_size_spark(m).select(F.lit(model_name(r)).alias("model"), "size_mb", steps.alias("provenance")))
    return reduce(DataFrame.unionByName, parts)


@register("model_grid", lambda: f"SELECT model, lang, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}, "
                                f"num_queries, skipped FROM ({_grid_sql()})")
def q_model_grid(spark, sf):
    return RP.rounded(_grid_plan(spark, sf))


@register("macro_average", lambda: f"SELECT model, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)}, "
          f"count(*)::BIGINT AS num_languages FROM ({_grid_sql()}) GROUP BY model")
def q_macro_average(spark, sf):
    return RP.rounded(RP.macro_average(grid(spark, sf), METRICS))


FLAT = [*METRICS, "num_queries", "passages"]


def _flat_sql(metrics=FLAT):
    per_lang = (f"SELECT g.*, coalesce(t.n, 0) AS passages FROM ({_grid_sql()}) g LEFT JOIN (SELECT lang, count(*) AS n "
                f"FROM documents WHERE doc_id % 7 <> 0 GROUP BY lang) t ON t.lang IS NOT DISTINCT FROM g.lang")
    return " UNION ALL ".join(f"SELECT model, '{m}_' || coalesce(lang, '') AS name, {m}::DOUBLE AS value FROM ({per_lang})"
                              for m in metrics)


@register("flat_metrics", lambda: f"SELECT model, name, round(value, 6) AS value FROM ({_flat_sql()})")
def q_flat_metrics(spark, sf):
    passages = T.passages_b(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("passages"))
    per_lang = grid(spark, sf).join(passages.withColumnRenamed("lang", "_lang"),
                                    F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return RP.rounded(RP.flat_metrics(per_lang, FLAT))


def _sizes_sql():
    parts = [f"SELECT '{model_name(r)}' AS model, round(({_size_sql_expr(r)}) / 1e6, 6) AS size_mb FROM "
             f"(SELECT count(*) AS n, sum(len(embedding)) AS e FROM embeddings)" for r in GRID]
    return " UNION ALL ".join(parts)


def _summary_sql():
    macro = f"SELECT model, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM ({_grid_sql()}) GROUP BY model"
    return (f"SELECT s.model, s.size_mb, {', '.join(f'round(coalesce(m.{x}, 0.0), 6) AS {x}' for x in METRICS)}, "
            f"round(coalesce(columns(p.* EXCLUDE (model)), 0.0), 6) FROM ({_sizes_sql()}) s "
            f"LEFT JOIN ({macro}) m USING (model) LEFT JOIN (PIVOT ({_flat_sql(METRICS[:1])}) ON name "
            f"USING max(value) GROUP BY model) p USING (model)")


@register("summary_table", _summary_sql)
def q_summary_table(spark, sf):
    return RP.summary_table(grid(spark, sf), sizes(spark, sf), METRICS)


@register("summary_by_score", _summary_sql)
def q_summary_by_score(spark, sf):
    return RP.summary_by_score(q_summary_table(spark, sf), "ndcg_10")


@register("quality_retention", lambda: (
    f"SELECT g.model, g.lang, round(CASE WHEN b.ndcg_10 > 0 THEN g.ndcg_10 / b.ndcg_10 ELSE 0.0 END, 6) AS retention "
    f"FROM ({_grid_sql()}) g LEFT JOIN (SELECT lang, ndcg_10 FROM ({_grid_sql()}) WHERE model = '{BASE}') b USING (lang)"))
def q_quality_retention(spark, sf):
    return RP.quality_retention(grid(spark, sf), "ndcg_10", BASE)


def _points_sql():
    macro = f"SELECT model, avg(ndcg_10) AS metric FROM ({_grid_sql()}) GROUP BY model"
    return f"SELECT s.model, s.size_mb, round(m.metric, 6) AS metric FROM ({_sizes_sql()}) s JOIN ({macro}) m USING (model)"


def _points(spark, sf):
    macro = grid(spark, sf).groupBy("model").agg(F.round(F.avg("ndcg_10"), 6).alias("metric"))
    return sizes(spark, sf).join(macro, "model")


@register("pareto_frontier", lambda: (
    f"SELECT model, size_mb, metric FROM (SELECT *, max(metric) OVER (ORDER BY size_mb ASC, metric DESC, model ASC "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ({_points_sql()})) "
    f"WHERE best IS NULL OR metric > best"))
def q_pareto_frontier(spark, sf):
    return RP.pareto_frontier(_points(spark, sf))


def _results(spark, sf):
    return RP.results_rows(grid(spark, sf), sizes(spark, sf), METRICS)


@register("result_points", lambda: (
    f"SELECT s.model AS name, s.size_mb, m.ndcg_10 AS value, CASE WHEN s.model LIKE '%turbo%' THEN "
    f"regexp_extract(s.model, '(turbo[^_]*)', 1) ELSE 'other' END AS \"group\" FROM ({_sizes_sql()}) s "
    f"JOIN (SELECT model, round(avg(ndcg_10), 6) AS ndcg_10 FROM ({_grid_sql()}) GROUP BY model) m USING (model)"))
def q_result_points(spark, sf):
    return RP.result_points(_results(spark, sf), "ndcg_10", "turbo")


def _results_json_sql():
    macro = f"SELECT model, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM ({_grid_sql()}) GROUP BY model"
    rows = " UNION ALL ".join(
        f"SELECT model, {i} AS nth, '{m}' AS metric, {m} AS value FROM ({macro})" for i, m in enumerate(METRICS))
    steps = ", ".join(f"('{model_name(r)}', '{BASE if r == 'baseline' else f'{BASE}/{r}'}')" for r in GRID)
    return (f"SELECT 'grid' AS label, s.model AS name, s.size_mb, r.metric, r.value, p.provenance FROM ({_sizes_sql()}) s "
            f"JOIN ({rows}) r USING (model) JOIN (VALUES {steps}) p(model, provenance) USING (model)")


@register("results_json", _results_json_sql)
def q_results_json(spark, sf):
    """The run's document, written as a file and read back, one row per result and metric
    (its timestamp left out)."""
    path = scratch_path(spark, "results")
    RP.results_json(_results(spark, sf), "grid").write.text(path)
    back = RP.read_results_json(spark, path)
    return back.select("label", "name", "size_mb", F.explode("metrics").alias("metric", "value"),
                       F.array_join("provenance", "/").alias("provenance"))


def _resumed_sql():
    from .registry import _sql_eval_full_lang
    return " UNION ALL ".join(f"SELECT '{model_name(r)}' AS model, * FROM ({_sql_eval_full_lang(r)}) WHERE lang IS NOT NULL"
                              for r in RESUMED)


@register("resume_progress", _resumed_sql)
def q_resume_progress(spark, sf):
    """A run over (model, language) that is stopped half-way and taken up by a second one;
    the log at its end, without the seconds it also holds."""
    v = vocab(spark, sf, base(spark, sf))
    models = {model_name(r): model_artifact(spark, sf, r) for r in RESUMED}
    langs = T.texts(spark, sf).where("lang is not null").select("lang").distinct()
    requested = langs.withColumn("model", F.explode(F.array(*map(F.lit, models)))).select("model", "lang")
    j = T.judgments_b(spark, sf)
    held = {}                   # the lexicon of a model, for all its languages

    def score(model: str, lang: str) -> DataFrame:
        if model not in held:
            held[model] = E.held_for(models[model], v, T.topics_b(spark, sf), T.passages_b(spark, sf))
        one = lambda df: df.where(F.col("lang") == lang)      # noqa: E731
        of = M.Judgments(query_keys=one(j.query_keys), doc_keys=one(j.doc_keys), keys=j.keys, by=j.by)
        return E.eval_full(models[model], v, one(T.topics_b(spark, sf)), one(T.passages_b(spark, sf)), of,
                           group_cols=("lang",), held=held[model]).drop("lang")

    log = scratch_path(spark, "progress")
    PR.resume(spark, log, requested, FULL, score, at_most=max(1, requested.count() // 2))
    return RP.rounded(PR.resume(spark, log, requested, FULL, score).drop("seconds"))


def _totals(spark, sf):
    m0 = base(spark, sf)
    m = model_artifact(spark, sf, "turbo-lloyd-1")
    e = E.eval_full(m, vocab(spark, sf, m0), T.topics_b(spark, sf), T.passages_b(spark, sf),
                    T.judgments_b(spark, sf), group_cols=("lang",))
    return e.withColumn("model", F.lit(model_name("turbo-lloyd-1")))


@register("corpus_totals", lambda: _totals_sql())
def q_corpus_totals(spark, sf):
    return RP.corpus_totals(_totals(spark, sf))


# --------------------------------------------------------------------------
# task scores over embedding pairs (consecutive vec_ids, gold = same label)
# --------------------------------------------------------------------------

def _pair_scores(spark, sf) -> DataFrame:
    m = base(spark, sf)
    cos = R.similarity_pairwise(T.pairs(spark, sf), m.weights, m.dim)
    return cos.join(T.pairs(spark, sf).select("pair_id", "gold"), "pair_id").select(
        "pair_id", F.round("cosine", 9).alias("score"), "gold",
        F.when(F.col("pair_id") % 2 == 0, "test").otherwise("validation").alias("split"),
        F.lit("pairs").alias("task"))


def _pairs_sql():
    s = O.Sql()
    n = s.normalised(s.dense(), "dn")
    s.add("pc", f"SELECT a.text_id // 2 AS pair_id, sum(a.v * b.v) AS cos FROM {n} a JOIN {n} b "
                f"ON b.text_id = a.text_id + 1 AND a.dim = b.dim WHERE a.text_id % 2 = 0 GROUP BY a.text_id")
    return s.build(
        "SELECT a.vec_id // 2 AS pair_id, round(c.cos, 9) AS score, (a.label = b.label)::INTEGER AS gold, "
        "CASE WHEN (a.vec_id // 2) % 2 = 0 THEN 'test' ELSE 'validation' END AS split, 'pairs' AS task "
        "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN pc c ON c.pair_id = a.vec_id // 2 "
        "WHERE a.vec_id % 2 = 0")


def _spearman_sql(part):
    p = ", ".join(part)
    return (f"SELECT {p}, round(corr(rx, ry), 6) AS spearman FROM (SELECT {p}, "
            f"rank() OVER (PARTITION BY {p} ORDER BY score) + (count(*) OVER (PARTITION BY {p}, score) - 1) / 2.0 AS rx, "
            f"rank() OVER (PARTITION BY {p} ORDER BY gold) + (count(*) OVER (PARTITION BY {p}, gold) - 1) / 2.0 AS ry "
            f"FROM ({_pairs_sql()})) GROUP BY {p}")


def _ap_sql(part):
    p = ", ".join(part)
    return (f"SELECT {p}, round(coalesce(sum(CASE WHEN gold > 0 THEN tp / n END) / sum(gold), 0.0), 6) AS average_precision "
            f"FROM (SELECT {p}, gold, sum(gold) OVER w AS tp, count(*) OVER w AS n FROM ({_pairs_sql()}) "
            f"WINDOW w AS (PARTITION BY {p} ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
            f"GROUP BY {p}")


@register("sts_spearman", lambda: _spearman_sql(["task"]))
def q_sts_spearman(spark, sf):
    return TK.spearman(_pair_scores(spark, sf), "score", "gold", ["task"])


@register("pair_average_precision", lambda: _ap_sql(["task"]))
def q_pair_average_precision(spark, sf):
    return TK.average_precision(_pair_scores(spark, sf), "score", "gold", ["task"])


def _task_scores(spark, sf) -> DataFrame:
    ps = _pair_scores(spark, sf)
    sp = TK.spearman(ps, "score", "gold", ["task", "split"]).select(
        F.lit("sts").alias("task"), "split", F.col("spearman").alias("score"))
    ap = TK.average_precision(ps, "score", "gold", ["task", "split"]).select(
        F.lit("pair_ap").alias("task"), "split", F.col("average_precision").alias("score"))
    return sp.unionByName(ap).withColumn("split_pos", F.when(F.col("split") == "test", 1).otherwise(0)) \
             .withColumn("subset_pos", F.lit(0))


def _main_sql():
    return (f"SELECT 'sts' AS task, spearman AS main_score FROM ({_spearman_sql(['task', 'split'])}) WHERE split = 'test' "
            f"UNION ALL SELECT 'pair_ap' AS task, average_precision AS main_score FROM ({_ap_sql(['task', 'split'])}) "
            f"WHERE split = 'test'")


@register("main_score", _main_sql)
def q_main_score(spark, sf):
    return TK.main_score(_task_scores(spark, sf))


@register("task_average", lambda: f"SELECT round(coalesce(avg(main_score), 0.0), 6) AS task_avg, count(*)::BIGINT AS num_tasks FROM ({_main_sql()})")
def q_task_average(spark, sf):
    return TK.task_average(TK.main_score(_task_scores(spark, sf)))


@register("classification_accuracy")
def q_classification_accuracy(spark, sf):
    """Each class column of ``labels`` learned from the encoded documents: task, accuracy, test_rows."""
    m = model_artifact(spark, sf, "turbo-lloyd-1")
    vectors = cut_lineage(encode(T.texts(spark, sf), m, vocab(spark, sf, base(spark, sf))), "encoded")
    rows = vectors.join(T.table(spark, sf, "labels").withColumnRenamed("doc_id", "text_id"), "text_id")
    parts = [TK.classification_accuracy(rows, c, key="text_id").select(F.lit(c).alias("task"), "*")
             for c in ("quality", "toxic")]
    return parts[0].unionByName(parts[1])


# --------------------------------------------------------------------------
# SQL of the grid
# --------------------------------------------------------------------------

def _pooled_lang_sql(r: str) -> str:
    s = O.Sql()
    w = s.model(r)
    s.add("jb", O.JUDGED_B)
    s.add("jq", f"SELECT text_id, text FROM ({O.TOPICS_B}) WHERE text_id IN (SELECT qid FROM jb)")
    s.add("pool", "SELECT doc_id::BIGINT AS text_id, text FROM documents p WHERE doc_id % 7 <> 0 AND EXISTS "
                  "(SELECT 1 FROM documents q WHERE q.doc_id % 7 = 0 AND q.lang = p.lang AND q.source = p.source)")
    q = s.encode("SELECT * FROM jq", w, "qe")
    p = s.encode("SELECT * FROM pool", w, "pe")
    rk = s.ranked(s.scores(q, p, "sc", same_lang=True), 10, "rk")
    pq = s.metrics(rk, O.LABELS_B, "SELECT * FROM jb", (10,), (10, 3), "pq", group="lang")
    return s.build(s.every_lang(s.summary(pq, (10,), (10, 3), group="lang", digits=None), METRICS))


def _grid_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{model_name(r)}' AS model, * FROM ({_pooled_lang_sql(r)})" for r in GRID)


def _totals_sql() -> str:
    from .registry import _sql_eval_full_lang
    return ("SELECT 'embeddings_turbo-lloyd-1' AS model, sum(num_queries)::BIGINT AS total_queries, "
            "sum(total_passages)::BIGINT AS total_passages, count(*)::BIGINT AS num_languages FROM ("
            + _sql_eval_full_lang() + ")")


assert set(GRID) <= set(SIZE_RECIPES)
