"""Plan-shape guards for the scale properties the design relies on."""
import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from vectorloom.operators import learn as L
from vectorloom.plans import registry


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_no_cross_products_in_headline_plans(spark, sf):
    import __spark_entry__ as e
    qs = e.queries()
    for k in ("encode", "topk_full", "eval_full_lang", "eval_pooled", "similarity_matrix", "kmeans_assign",
              "sts_spearman", "pair_average_precision", "main_score", "covariance", "model_grid",
              "pareto_frontier", "nearest_rows", "ranked_rels"):
        p = _plan(qs[k](spark, sf))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, k


def test_encode_and_topk_shapes(spark, sf):
    import __spark_entry__ as e
    enc = _plan(e.queries()["encode"](spark, sf))
    assert "BroadcastHashJoin" in enc and "SortMergeJoin" not in enc
    assert enc.count("HashAggregate") >= 2            # partial + final around one exchange
    top = _plan(e.queries()["topk_full"](spark, sf))
    assert "MapInArrow" in top and "WindowGroupLimit" in top
    scan = _plan(registry.QUERIES["tokenize"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan   # only the needed columns


def test_pq_error_close_to_numpy_lloyd(spark, sf):
    m = registry.base(spark, sf)
    x = np.array([r["embedding"] for r in m.weights.orderBy("row_id").collect()])
    init = L.init_centroids(m.weights, 16, m.dim)
    dsub = m.dim // 8
    err_np = 0.0
    for j in range(8):
        xs, c = x[:, j * dsub:(j + 1) * dsub], init[:, j * dsub:(j + 1) * dsub].copy()
        for _ in range(4):
            a = ((xs[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            for t in range(16):
                if (a == t).any():
                    c[t] = xs[a == t].mean(0)
        err_np += ((xs - c[((xs[:, None] - c[None]) ** 2).sum(-1).argmin(1)]) ** 2).sum()
    books = L.pq_fit(m.weights, 8, 16, m.dim, iters=4, tol=0)
    from vectorloom.operators import kernels
    err = kernels.assign_codes(m.weights, books).agg(F.sum("sq_dist")).first()[0]
    assert err <= 1.1 * err_np + 1e-9
