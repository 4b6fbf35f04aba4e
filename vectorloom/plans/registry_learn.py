"""Registered queries: learned compression (centring, covariance, PCA, k-means, PQ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import learn as L
from . import oracle as O
from .registry import base, register

K_TEST = 16
PQ_M, PQ_K = 8, 16


def _sql_center():
    s = O.Sql()
    d = s.dense()
    return s.build(f"SELECT row_id, dim, round(x - avg(x) OVER (PARTITION BY dim), 6) AS value FROM {d}")


@register("center_columns", _sql_center)
def q_center_columns(spark, sf):
    m = base(spark, sf)
    return V.long_form(L.center_columns(m.weights, m.dim), "row_id", "embedding")


def _sql_cov():
    s = O.Sql()
    d = s.dense()
    s.add("cen", f"SELECT row_id, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM {d}")
    return s.build("SELECT a.dim AS i, b.dim AS j, round(sum(a.x * b.x), 6) AS value FROM cen a "
                   "JOIN cen b ON a.row_id = b.row_id GROUP BY a.dim, b.dim")


@register("covariance", _sql_cov)
def q_covariance(spark, sf):
    m = base(spark, sf)
    return L.covariance(m.weights, m.dim).select("i", "j", F.round("value", 6).alias("value"))


def _init_sql(s: O.Sql, k: int) -> str:
    d = s.dense()
    s.add("init", f"SELECT row_id, (row_number() OVER (ORDER BY {L.hash_sql(L.SEED)}, "
                  f"row_id) - 1)::INTEGER AS cid FROM (SELECT DISTINCT row_id FROM {d}) QUALIFY cid < {k}")
    return s.add("cent", f"SELECT i.cid, d.dim, d.x FROM init i JOIN {d} d USING (row_id)")


def _assign_sql(s: O.Sql, cent: str, name: str) -> str:
    d = s.dense()
    s.add(f"{name}_dist", f"SELECT d.row_id, c.cid, round(sum((d.x - c.x) * (d.x - c.x)), 9) AS dist "
                          f"FROM {d} d JOIN {cent} c ON c.dim = d.dim GROUP BY d.row_id, c.cid")
    return s.add(name, f"SELECT row_id, cid, dist FROM {name}_dist "
                       f"QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dist, cid) = 1")


def _sql_kassign():
    s = O.Sql()
    a = _assign_sql(s, _init_sql(s, K_TEST), "asg")
    return s.build(f"SELECT row_id, cid, round(dist, 6) AS sq_dist FROM {a}")


@register("kmeans_assign", _sql_kassign)
def q_kmeans_assign(spark, sf):
    m = base(spark, sf)
    cent = L.init_centroids(m.weights, K_TEST, m.dim)
    return L.kmeans_assign(m.weights, cent).select(
        "row_id", F.col("cid").cast("int"), F.round("sq_dist", 6).alias("sq_dist"))


def _sql_kstep():
    s = O.Sql()
    c0 = _init_sql(s, K_TEST)
    a = _assign_sql(s, c0, "asg")
    d = s.dense()
    return s.build(f"SELECT a.cid, d.dim, round(avg(d.x), 6) AS value FROM {a} a JOIN {d} d USING (row_id) "
                   f"GROUP BY a.cid, d.dim")


@register("kmeans_step", _sql_kstep)
def q_kmeans_step(spark, sf):
    m = base(spark, sf)
    cent = L.init_centroids(m.weights, K_TEST, m.dim)
    new, _ = L.kmeans_step(m.weights, cent)
    rows = [(int(c), int(j), round(float(new[c, j]), 6)) for c in range(len(new)) for j in range(m.dim)]
    return spark.createDataFrame(rows, "cid int, dim int, value double")


# Lloyd steps unrolled in SQL: more than the fits need at the scale of the check, and a step
# that finds every centroid at rest changes nothing
SQL_STEPS = 45


def _lloyd_sql(s: O.Sql, cur: str, steps: int) -> str:
    d = s.dense()
    for t in range(steps):
        a = _assign_sql(s, cur, f"asg{t}")
        s.add(f"mean{t}", f"SELECT a.cid, x.dim, avg(x.x) AS x FROM {a} a JOIN {d} x USING (row_id) GROUP BY a.cid, x.dim")
        cur = s.add(f"cent{t + 1}", f"SELECT c.cid, c.dim, coalesce(m.x, c.x) AS x FROM {cur} c "
                                    f"LEFT JOIN mean{t} m USING (cid, dim)")
    return cur


def _sql_kmeans_fit(steps: int = SQL_STEPS):
    s = O.Sql(materialized=True)
    a = _assign_sql(s, _lloyd_sql(s, _init_sql(s, K_TEST), steps), "final")
    return s.build(f"SELECT row_id AS token_id, cid FROM {a}")


@register("kmeans_fit", _sql_kmeans_fit)
def q_kmeans_fit(spark, sf):
    """k-means (k=16) from the hash-picked rows by full Lloyd steps until the centroids rest;
    token_to_row of the clustered model."""
    c = L.cluster_global(base(spark, sf), K_TEST, method="lloyd")
    return c.token_to_row.select(F.col("token_id").cast("bigint"), F.col("row_id").cast("int").alias("cid"))


@register("cluster_global")
def q_cluster_global(spark, sf):
    """Mini-batch k-means (k=16) from oversampled seeds; token_to_row of the clustered model."""
    c = L.cluster_global(base(spark, sf), K_TEST)
    return c.token_to_row.select(F.col("token_id").cast("bigint"), F.col("row_id").cast("int").alias("cid"))


def _sql_pq_encode():
    s = O.Sql()
    c0 = _init_sql(s, PQ_K)
    dsub = 64 // PQ_M
    d = s.dense()
    s.add("pqd", f"SELECT d.row_id, c.cid, d.dim // {dsub} AS sub, round(sum((d.x - c.x) * (d.x - c.x)), 9) AS dist "
                 f"FROM {d} d JOIN {c0} c ON c.dim = d.dim GROUP BY d.row_id, c.cid, d.dim // {dsub}")
    return s.build("SELECT row_id, sub::INTEGER AS sub, cid AS code FROM pqd "
                   "QUALIFY row_number() OVER (PARTITION BY row_id, sub ORDER BY dist, cid) = 1")


def _codes_by_sub(df):
    return df.select("row_id", F.posexplode("codes").alias("sub", "code")).select(
        "row_id", F.col("sub").cast("int"), F.col("code").cast("int"))


@register("pq_encode", _sql_pq_encode)
def q_pq_encode(spark, sf):
    m = base(spark, sf)
    init = L.init_centroids(m.weights, PQ_K, m.dim)
    dsub = m.dim // PQ_M
    import numpy as np
    books = np.stack([init[:, j * dsub:(j + 1) * dsub] for j in range(PQ_M)])
    return _codes_by_sub(L.pq_encode(m.weights, books))


def _sql_pq(steps: int = SQL_STEPS, books: bool = False):
    s = O.Sql(materialized=True)
    d = s.dense()
    dsub = 64 // PQ_M
    h = L.hash_sql(L.SEED, "sub")
    s.add("init", f"SELECT sub, row_id, (row_number() OVER (PARTITION BY sub ORDER BY {h}, row_id) - 1)::INTEGER AS cid "
                  f"FROM (SELECT DISTINCT row_id FROM {d}), (SELECT range AS sub FROM range({PQ_M})) QUALIFY cid < {PQ_K}")
    cur = s.add("cent", f"SELECT i.cid, d.dim, d.x FROM init i JOIN {d} d ON d.row_id = i.row_id AND d.dim // {dsub} = i.sub")

    def assign(c, name):
        s.add(f"{name}_d", f"SELECT x.row_id, c.cid, x.dim // {dsub} AS sub, round(sum((x.x - c.x) * (x.x - c.x)), 9) AS dist "
                           f"FROM {d} x JOIN {c} c ON c.dim = x.dim GROUP BY x.row_id, c.cid, x.dim // {dsub}")
        return s.add(name, f"SELECT row_id, sub, cid AS code FROM {name}_d "
                           f"QUALIFY row_number() OVER (PARTITION BY row_id, sub ORDER BY dist, cid) = 1")

    for t in range(steps):
        a = assign(cur, f"pqa{t}")
        s.add(f"pqm{t}", f"SELECT a.code AS cid, x.dim, avg(x.x) AS x FROM {a} a JOIN {d} x "
                         f"ON x.row_id = a.row_id AND x.dim // {dsub} = a.sub GROUP BY a.code, x.dim")
        cur = s.add(f"pqc{t + 1}", f"SELECT c.cid, c.dim, coalesce(m.x, c.x) AS x FROM {cur} c "
                                   f"LEFT JOIN pqm{t} m USING (cid, dim)")
    if books:
        return s.build(f"SELECT (dim // {dsub})::INTEGER AS sub, cid AS code, (dim % {dsub})::INTEGER AS dim, "
                       f"round(x, 6) AS value FROM {cur}")
    a = assign(cur, "pqfinal")
    return s.build(f"SELECT row_id, sub::INTEGER AS sub, code FROM {a}")


@register("pq", _sql_pq)
def q_pq(spark, sf):
    """PQ m=8, k=16, every part from hash-picked rows of its own, fitted until it rests."""
    return _codes_by_sub(L.pq(base(spark, sf), PQ_M, PQ_K).weights)


@register("pca")
def q_pca(spark, sf):
    m = base(spark, sf)
    return V.long_form(L.pca(m, 16).weights, "row_id", "embedding")
