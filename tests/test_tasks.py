import numpy as np

from vectorloom.operators import tasks as TK


def _avg_ranks(x):
    order = np.argsort(x, kind="stable")
    r = np.empty(len(x))
    r[order] = np.arange(1, len(x) + 1)
    for v in np.unique(x):
        m = x == v
        r[m] = r[m].mean()
    return r


def _ap(score, label):
    out = []
    for i in np.where(label > 0)[0]:
        ge = score >= score[i]
        out.append(label[ge].sum() / ge.sum())
    return float(np.mean(out)) if out else 0.0


def test_spearman_and_ap_match_definitions(spark):
    rng = np.random.default_rng(4)
    rows, ref = [], {}
    for task in ("a", "b"):
        n = 400
        score = np.round(rng.standard_normal(n), 1)          # many ties
        gold = (score + rng.standard_normal(n) > 0).astype(int)
        rows += [(task, float(s), int(g)) for s, g in zip(score, gold)]
        rx, ry = _avg_ranks(score), _avg_ranks(gold.astype(float))
        ref[task] = (np.corrcoef(rx, ry)[0, 1], _ap(score, gold))
    df = spark.createDataFrame(rows, "task string, score double, gold int").repartition(5)
    sp = {r["task"]: r["spearman"] for r in TK.spearman(df, "score", "gold", ["task"]).collect()}
    ap = {r["task"]: r["average_precision"] for r in TK.average_precision(df, "score", "gold", ["task"]).collect()}
    for t in ("a", "b"):
        assert abs(sp[t] - ref[t][0]) < 2e-6 and abs(ap[t] - ref[t][1]) < 2e-6


def test_main_score_counts_a_missing_score_as_zero(spark):
    from vectorloom.operators import tasks
    rows = [("a", "test", 0, 0, None), ("a", "test", 0, 1, 0.9), ("b", "dev", 0, 0, 0.4), ("c", "dev", 0, 0, 0.2),
            ("c", "test", 1, 0, 0.7)]
    df = spark.createDataFrame(rows, "task string, split string, split_pos int, subset_pos int, score double")
    assert {r.task: r.main_score for r in tasks.main_score(df).collect()} == {"a": 0.0, "b": 0.4, "c": 0.7}
