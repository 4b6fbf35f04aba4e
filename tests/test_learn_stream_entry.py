import numpy as np
from pyspark.sql import functions as F

from vectorloom.operators import learn as L
from vectorloom.plans import registry
from vectorloom.sources import testdata as T


def _numpy_lloyd(x, init, iters):
    c = init.copy()
    for _ in range(iters):
        a = ((x[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].mean(0)
    return ((x - c[((x[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)]) ** 2).sum()


def test_kmeans_matches_numpy_lloyd(spark, sf):
    m = registry.base(spark, sf)
    x = np.array([r["embedding"] for r in m.weights.orderBy("row_id").collect()])
    init = L.init_centroids(m.weights, 8, m.dim)
    cent = L.kmeans_fit(m.weights, 8, m.dim, iters=5, tol=0)
    a = L.kmeans_assign(m.weights, cent).agg(F.sum("sq_dist")).first()[0]
    assert a <= 1.1 * _numpy_lloyd(x, init, 5) + 1e-9


def test_pq_codes_in_range_and_pca(spark, sf):
    m = registry.base(spark, sf)
    p = L.pq(m, 8, 16, iters=3)
    codes = np.array([r["codes"] for r in p.weights.collect()])
    assert codes.shape == (m.num_rows, 8) and codes.min() >= 0 and codes.max() < 16
    pc = L.pca(m, 8)
    y = np.array([r["embedding"] for r in pc.weights.collect()])
    assert y.shape == (m.num_rows, 8) and np.allclose(np.linalg.norm(y, axis=1), 1)
    try:
        L.pca(m, 65)
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_stream_topk_equals_batch(spark, sf):
    from vectorloom.plans import registry_streams as RS
    batch = {tuple(r) for r in registry.QUERIES["topk_full"](spark, sf).collect()}
    stream = {tuple(r) for r in RS.q_stream_topk(spark, sf).collect()}
    assert batch == stream
    RS.SHARDS, old = 3, RS.SHARDS
    try:
        assert {tuple(r) for r in RS.q_stream_topk(spark, sf).collect()} == batch
    finally:
        RS.SHARDS = old


def test_entry_and_registry(spark):
    import __spark_entry__ as e
    rows = e.entry(spark).collect()
    assert len(rows) == 1 and 0 <= rows[0]["ndcg_10"] <= 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pca_subspace_matches_numpy_svd(spark, sf):
    m = registry.base(spark, sf)
    rows = m.weights.orderBy("row_id").collect()
    x = np.array([r["embedding"] for r in rows])
    xc = x - x.mean(0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    p = xc @ vt[:8].T
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    got = {r["row_id"]: r["embedding"] for r in L.pca(m, 8).weights.collect()}
    y = np.array([got[r["row_id"]] for r in rows])
    assert np.allclose(y @ y.T, p @ p.T, atol=1e-6)       # sign-free comparison


def test_stream_goes_on_from_its_state(spark, sf):
    """Half of the shards, a restart with the other half, and a restart with nothing new: the state
    equals the batch ranking, and nothing but the stream's checkpoint was written."""
    import os
    import shutil
    import tempfile
    from vectorloom.plans import registry_streams as RS
    from vectorloom.session import scratch_path
    from vectorloom.streaming import corpus as S
    m, v = registry._model_and_vocab(spark, sf)
    q = RS._topic_vectors(spark, sf, m, v)
    src, ckpt = RS.write_stream_passages(spark, sf), scratch_path(spark, "ck")
    arriving = tempfile.mkdtemp(prefix="vectorloom-arriving-")
    shards = sorted(f for f in os.listdir(src) if f.endswith(".gz"))
    run = lambda: S.stream_topk(RS._stream(spark, arriving), q, m, v, 100, ckpt)[0]     # noqa: E731
    for half in (shards[:4], shards[4:], []):
        for f in half:
            shutil.copy(f"{src}/{f}", arriving)
        top = run()
    batch = {tuple(r) for r in registry.QUERIES["topk_full"](spark, sf).collect()}
    assert {tuple(r) for r in RS._ranked_out(top).collect()} == batch
    assert os.listdir(os.path.dirname(ckpt)) and not any(
        f.endswith(".parquet") for _, _, files in os.walk(ckpt) for f in files)


def test_stateful_stream_equals_batch(spark, sf):
    from vectorloom.plans import registry_streams as RS
    batch = {tuple(r) for r in registry.QUERIES["nearest_rows"](spark, sf).collect()}
    stream = {tuple(r) for r in RS.q_stream_nearest(spark, sf).collect()}
    assert batch == stream and len(batch) == 50 * 10
