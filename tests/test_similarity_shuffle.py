import numpy as np
from pyspark.sql import functions as F

from vectorloom.operators import kernels, rank


def test_all_pairs_send_each_side_least_often_in_single_precision(spark, monkeypatch):
    """Rows were sent twice and queries nine times or more, as normalised doubles."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(260, 8)).astype(np.float32).astype(float)
    x[7], x[8], x[100] = 0.0, rng.normal(size=8), rng.normal(size=8) * 1e60        # not in single precision
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[1].tolist()), (900, None)],
                                 "id bigint, embedding array<double>")
    kind, sent = type(rows), []
    real = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, *a: sent.append(self) or real(self, *a))
    a, b = rows.where("id % 10 = 0 or id = 900"), rows.where("id % 10 <> 0 or id is null")
    got = {(r["qid"], r["docid"]): r["score"] for r in rank.similarity_matrix(a, b, 8, "id", "id").collect()}
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-8)[:, None]
    ids = np.arange(260)
    want = {(int(i), int(j)): float(unit[i] @ unit[j]) for i in ids[ids % 10 == 0] for j in ids[ids % 10 != 0]}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-9 for p in want)
    held = sent[0].select("side", F.col("v.single").isNotNull().alias("s")).groupBy("side").agg(
        F.count("*").alias("n"), F.sum((~F.col("s")).cast("int")).alias("wide")).collect()
    cores = spark.sparkContext.defaultParallelism
    assert {r["side"]: (r["n"], r["wide"]) for r in held} == {0: (26 * cores, cores), 1: (234, 1)}


def test_several_blocks_of_queries_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(rank, "QUERY_BLOCK_BYTES", 5 * (8 * 4 + 64))
    rng = np.random.default_rng(5)
    data = [(f"n{i}", rng.normal(size=4).tolist()) for i in range(40)]
    rows = spark.createDataFrame(data, "id string, embedding array<float>")
    monkeypatch.setattr(kernels, "PAIRS", 16)
    got = rank.similarity_matrix(rows.limit(12), rows, 4, "id", "id").collect()
    assert len(got) == 12 * 40 and len({(r["qid"], r["docid"]) for r in got}) == 480
    assert all(abs(r["score"] - 1) < 1e-6 for r in got if r["qid"] == r["docid"])
