"""Fits: the fused step's plan, unrolled steps in SQL, mini-batch against full Lloyd, convergence."""
import warnings

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import learn as L
from vectorloom.plans import registry, registry_learn


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _duck(sf, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    return {tuple(r) for r in con.execute(sql).fetchall()}


def test_a_step_is_one_pass_and_one_exchange(spark, sf):
    m = registry.base(spark, sf)
    plan = _plan(L.step_sums(m.weights, L.pq_seeds(m.weights, 8, 16, m.dim)))
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("MapInArrow") == 1


def test_two_steps_equal_unrolled_sql(spark, sf):
    m = registry.base(spark, sf)
    cent = L.kmeans_fit(m.weights, registry_learn.K_TEST, m.dim, iters=2, tol=None)
    got = {tuple(r) for r in L.kmeans_assign(m.weights, cent).select("row_id", "cid").collect()}
    assert got == _duck(sf, registry_learn._sql_kmeans_fit(2))
    books = L.pq_fit(m.weights, 8, 16, m.dim, iters=2, tol=None)
    got = {tuple(r) for r in registry_learn._codes_by_sub(L.pq_encode(m.weights, books)).collect()}
    assert got == _duck(sf, registry_learn._sql_pq(2))


def test_parts_have_seeds_of_their_own(spark, sf):
    m = registry.base(spark, sf)
    x = {r["row_id"]: np.array(r["embedding"]) for r in m.weights.collect()}
    books = L.pq_seeds(m.weights, 8, 4, m.dim)
    picked = [tuple(next(i for i, v in x.items() if np.array_equal(v[j * 8:j * 8 + 8], books[j, t])) for t in range(4))
              for j in range(8)]
    assert len(set(picked)) == 8 and all(len(set(p)) == 4 for p in picked)
    few = m.weights.limit(3)
    assert np.isfinite(L.pq_fit(few, 8, 16, m.dim)).all()


def test_minibatch_is_close_to_full_lloyd(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 16)) * 3
    x = centres[rng.integers(0, 60, 20_000)] + rng.normal(size=(20_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, embedding array<double>")
    df = df.repartition(8).cache()
    fit = L.minibatch_fit(df, 40, 16, batch_rows=1500)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        full = L.lloyd(df, L.init_centroids(df, 40, 16)[None], 25, 0.0)
    inertia = lambda books: L.kmeans_assign(df, books[0]).agg(F.sum("sq_dist")).first()[0]
    assert fit.converged and fit.steps > 0
    assert inertia(fit.books) <= 1.1 * inertia(full.books)
    again = L.minibatch_fit(df.repartition(3), 40, 16, batch_rows=1500)
    assert np.allclose(again.books, fit.books, atol=1e-6)          # draws follow the ids, not the partitions


def test_fit_says_when_it_did_not_converge(spark, sf):
    m = registry.base(spark, sf)
    with pytest.warns(UserWarning, match="still moved"):
        L.kmeans_fit(m.weights, 16, m.dim, iters=2, tol=0.0)
    fit = L.lloyd(m.weights, L.init_centroids(m.weights, 16, m.dim)[None], 200, 1e-9)
    assert fit.converged and fit.steps < 200
    resting, _ = L.lloyd_step(m.weights, fit.books)
    assert np.abs(resting - fit.books).max() <= 1e-9


def test_rows_that_repeat_and_fewer_rows_than_centroids(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "row_id bigint, embedding array<double>")
    assert np.allclose(L.minibatch_fit(same, 3, 2).books, [1.0, 2.0])
    with pytest.raises(ValueError):
        L.pq_seeds(same, 3, 2, 2)
