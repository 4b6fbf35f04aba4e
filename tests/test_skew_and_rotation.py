"""The salted join, prefix sums over ranges and the butterfly rotation."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import joins as J
from vectorloom.functions.levels import butterfly, hadamard_blocks, hadamard_matrix, hadamard_signs
from vectorloom.operators import quantize as Q
from vectorloom.operators import tables as TB
from vectorloom.operators import tasks as TK


@pytest.fixture()
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")        # fixed partitions, so that task sizes show
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join_and_splits_the_hot_key(spark, no_broadcast, how):
    big = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None)
                                     .otherwise(F.col("id") % 500).cast("bigint").alias("k"))
    small = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(
        spark.createDataFrame([(7, -1), (None, 5)], "k bigint, v bigint"))
    out = J.skew_join(big, small, "k", how, max_bytes=1)
    plain = big.join(small, "k", how)
    assert sorted(map(str, out.select("id", "k", "v").collect())) == sorted(map(str, plain.select("id", "k", "v").collect()))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    rows = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    whole = [r["count"] for r in plain.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(whole) > 0.45 * sum(whole) and max(rows) < 0.3 * sum(rows)


def test_remap_and_resolve_beyond_the_broadcast_bound(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(J, "broadcast_if_bounded", lambda df, *_: (df, False))
    toks = spark.createDataFrame([(i, i % 5 if i % 2 else 3) for i in range(1000)], "text_id bigint, token_id bigint")
    ids = spark.createDataFrame([(1, 10), (3, 30)], "old_id bigint, new_id bigint")
    got = {(r.text_id, r.token_id) for r in TB.remap_token_ids(toks, ids).collect()}
    assert got == {(i, {1: 10, 3: 30}.get(t, 0)) for i, t in ((i, i % 5 if i % 2 else 3) for i in range(1000))}
    rows = spark.createDataFrame([(3, 9), (4, 8)], "token_id bigint, row_id bigint")
    assert {(r.token_id, r.row_id) for r in TB.resolve_token_rows(toks, rows).collect()} == {(3, 9), (4, 8)}


@pytest.mark.parametrize("partitions", [1, 3, 11])
@pytest.mark.parametrize("desc", [False, True])
def test_prefix_sums(spark, partitions, desc):
    rng = np.random.default_rng(1)
    rows = [(t, float(v), int(rng.integers(1, 9))) for t, n in (("a", 300), ("b", 5), (None, 40)) for v in range(n)]
    df = spark.createDataFrame(rows, "t string, v double, n bigint").repartition(4)
    got = {(r.t, r.v): r.before_n for r in TK.prefix_sums(df, "v", ["t"], ["n"], desc, partitions).collect()}
    assert got == {(t, v): sum(m for u, w, m in rows if u == t and (w > v if desc else w < v)) for t, v, _ in rows}


def test_equal_values_are_one_row(spark, monkeypatch):
    """A 0/1 gold column: what is dealt, sorted and ranked is the distinct values, not half of the rows."""
    written = []
    cut = TK.cut_lineage
    monkeypatch.setattr(TK, "cut_lineage", lambda df, name: written.append((name, cut(df, name).count())) or cut(df, name))
    df = spark.range(5000).select(F.lit("t").alias("task"), F.round(F.rand(3), 1).alias("s"), (F.col("id") % 2).alias("g"))
    TK.spearman(df, "s", "g", ["task"]).collect()
    assert written and max(n for _, n in written) <= 22
    assert TK.average_precision(df, "s", "g", ["task"]).count() == 1


def test_nulls_and_constant_columns(spark):
    rows = [("a", 1.0, 1), ("a", None, 1), ("a", 2.0, None), ("a", 3.0, 0), ("b", 1.0, 1), ("b", 1.0, 0), ("c", 5.0, 0)]
    df = spark.createDataFrame(rows, "task string, s double, g int")
    assert {r.task: r.spearman for r in TK.spearman(df, "s", "g", ["task"]).collect()} == {"a": -1.0, "b": None, "c": None}
    ap = {r.task: r.average_precision for r in TK.average_precision(df, "s", "g", ["task"]).collect()}
    assert ap == {"a": 0.5, "b": 0.5, "c": 0.0}
    ranks = {(r.task, r.s): r.rank for r in TK.avg_rank(df, "s", ["task"], "rank").collect()}
    assert ranks[("b", 1.0)] == 1.5 and ranks[("a", None)] is None
    assert TK.spearman(df.limit(0), "s", "g", ["task"]).collect() == []


@pytest.mark.parametrize("d", [1, 2, 64, 96, 100, 768])
def test_butterfly_equals_the_matrix_and_keeps_norms(d):
    x = np.random.default_rng(d).normal(size=(20, d))
    y = butterfly(x, np.array(hadamard_signs(d), dtype=float))
    assert sum(hadamard_blocks(d)) == d
    assert np.allclose(y, x @ hadamard_matrix(d), atol=1e-12)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1))


def test_rotate_hadamard_of_any_width(spark):
    x = np.random.default_rng(0).normal(size=(30, 96))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, embedding array<double>")
    got = {r.row_id: r.embedding for r in Q.rotate_hadamard(df.repartition(3), 96).collect()}
    assert np.allclose([got[i] for i in range(30)], x @ hadamard_matrix(96))
    assert Q.rotate_hadamard(df.limit(0), 96).collect() == []
