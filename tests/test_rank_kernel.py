"""The running top-k and the pooling of words, against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import kernels as K
from vectorloom.operators import rank as R
from vectorloom.operators import text as X
from vectorloom.plans import registry as G


@pytest.mark.parametrize("strings", [False, True])
@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("nq,n,k", [(7, 5, 10), (600, 2100, 10), (3, 2500, 100), (1, 1, 1)])
def test_running_topk_matches_sorting(strings, ties, nq, n, k):
    rng = np.random.default_rng(0)
    qm, x = rng.normal(size=(nq, 8)), rng.normal(size=(n, 8))
    if ties:
        qm, x = np.round(qm), np.round(x * 0.5)
    ids = rng.permutation(n)
    ids = np.array([f"d{i}" for i in ids], dtype=object) if strings else ids.astype(np.int64)
    best = K._Best(qm, k)
    for lo in range(0, n, 700):
        best.add(x[lo:lo + 700], ids[lo:lo + 700])
    q, i, s = best.rows(np.arange(nq))
    scores = np.round(qm @ x.T, K.SCORE_DIGITS)
    want = [(a, ids[j]) for a in range(nq) for j in sorted(range(n), key=lambda j: (-scores[a, j], ids[j]))[:k]]
    assert list(zip(q.tolist(), i.tolist())) == want
    assert sum(len(p.held[0]) for p in best.parts) == len(want)


def test_a_score_block_does_not_hold_all_its_products():
    """30,000 queries met all 10,000 rows of a batch at once: 2.4 GB of scores, and copies of them."""
    import tracemalloc
    qm, x = np.random.default_rng(1).normal(size=(8000, 4)), np.random.default_rng(2).normal(size=(4000, 4))
    tracemalloc.start()
    best = K._Best(qm, 2)
    best.add(x, np.arange(4000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * 1024 * 1024          # the scores alone are 256 MB


def test_lanes_follow_the_work_not_the_shuffle_partitions(spark):
    """Each lane sends the queries again and gives k rows of each: 64 lanes before."""
    rows = spark.range(5000).select("id", F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))
    q = rows.where("id < 600").withColumnRenamed("id", "qid")
    both, qt, rt = R._both(q, rows.withColumnRenamed("id", "docid"), "qid", "docid", "embedding", ())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = R.tiled_scores(both, q.select(F.lit("").alias("g")), 5, 2, qt, rt, False).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n <= 600 * 5 * 3 * spark.sparkContext.defaultParallelism


def test_pooling_kernel_equals_the_join(spark, sf, monkeypatch):
    m = G.model_artifact(spark, sf, "turbo-lloyd-1")
    v = G.vocab(spark, sf, m)
    words = [r.word for r in v.limit(5).collect()]
    rows = [(1, " ".join(words)), (1, words[0].upper()), (2, None), (3, ""), (4, "zzqq"), (None, words[1]),
            (5, " ".join(words * 20000))]
    texts = spark.createDataFrame(rows, "text_id bigint, text string")
    one = lambda df: {r[0]: np.array(r[1]) for r in df.collect()}       # noqa: E731
    plain = one(X.encode(texts, m, v, vocab_rows=m.tokens))
    many = {("a", k): x for k, x in plain.items()}
    monkeypatch.setattr(X, "SMALL_TEXTS_BYTES", 0)
    enc = X.encode(texts, m, v)
    assert "MapInArrow" in enc._jdf.queryExecution().toString() and "BroadcastHashJoin" not in enc._jdf.queryExecution().toString()
    held = one(enc)
    assert held.keys() == plain.keys() and all(np.allclose(held[k], plain[k], atol=1e-12) for k in plain)
    got = {(r[0], r[1]): np.array(r[2]) for r in X.encode_models(texts, {"a": m}, v).collect()}
    assert got.keys() == many.keys() and all(np.allclose(got[k], many[k], atol=1e-12) for k in many)


def test_held_lexicon_adds_up_repeated_words():
    rows = pa.table({"word": ["a", "b", "a", "c"], "embedding": pa.array([[1.0], [2.0], [4.0], None], pa.list_(pa.float64()))})
    lex = K.held_lexicon(rows, 2)
    sums, n = K.word_sums(pa.array([["a", "b", "c"], None, [], ["b", "x"]]), *lex)
    assert sums.tolist() == [[7, 0], [0, 0], [0, 0], [2, 0]] and n.tolist() == [3, 0, 0, 1]


def test_similarity_matrix_takes_a_tenth_of_the_vectors(spark, sf):
    n = G.base(spark, sf).weights.where("row_id % 10 = 0").count()
    assert G.QUERIES["similarity_matrix"](spark, sf).select("qid").distinct().count() == n


def test_lexicons_beyond_the_bound_are_held_in_parts(spark, sf, monkeypatch):
    models = {r: G.model_artifact(spark, sf, r) for r in ("baseline", "int8", "turbo-lloyd-1")}
    v = G.vocab(spark, sf, models["baseline"])
    doubled = models["int8"].derive(weights=models["int8"].weights.union(models["int8"].weights.where("row_id < 9")))
    models["twice"] = doubled
    words = [r.word for r in v.collect()]
    rows = [(1, " ".join(words)), (1, words[0].upper()), (2, None), (3, ""), (4, "zzqq"), (None, words[1]), (5, " ".join(words[:40] * 300))]
    texts = spark.createDataFrame(rows, "text_id bigint, text string")
    got = lambda: {(r[0], r[1]): np.array(r[2]) for r in X.encode_models(texts, models, v).collect()}      # noqa: E731
    joined = got()
    monkeypatch.setattr(X, "SMALL_TEXTS_BYTES", 0)
    whole = got()
    monkeypatch.setattr(X, "HELD_LEXICON_BYTES", len(words) * 300)
    assert len(X.sent_lexicons(models, v)) == 4         # two slices of one, two models, one
    monkeypatch.setattr(K, "DECODED_WORDS", 3)
    parts = got()
    assert joined.keys() == whole.keys() == parts.keys()
    for k in joined:
        assert np.allclose(joined[k], whole[k], atol=1e-12) and np.allclose(joined[k], parts[k], atol=1e-12), k
    plan = X.encode_models(texts, models, v)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_compact_lexicon_has_the_decoded_vectors(spark, sf):
    for m in [G.model_artifact(spark, sf, r) for r in ("baseline", "int8", "int4", "turbo-lloyd-2")] + [_packed(spark, sf)]:
        lex = X.lexicon(m, G.vocab(spark, sf, m))
        word, vectors, _ = X.held_compactly(lex, m, m.dim)
        assert isinstance(vectors, K.Coded) or vectors.dtype == np.float32
        want = {r[0]: r[1] for r in m.decoded(lex, ["word"]).collect()}
        taken = np.asarray(vectors[np.arange(len(word))], dtype=np.float64)
        assert len(want) == len(word) and all(want[w] == x for w, x in zip(word.to_pylist(), taken.tolist()))


def _packed(spark, sf):
    from vectorloom.sources.models import export_packed, packed_model
    return packed_model(*export_packed(G.recipe(spark, sf, "int4")))


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e12, 1e20])
def test_single_precision_loses_no_near_tie(scale):
    """Products are made in single precision: scores that only double tells apart keep their order."""
    rng = np.random.default_rng(3)
    qm, one = rng.normal(size=(40, 16)), rng.normal(size=16)
    x = one + rng.normal(size=(9000, 16)) * 1e-8
    ids = rng.permutation(len(x))
    best = K._Best(qm, 20)
    for lo in range(0, len(x), 3000):
        best.add(x[lo:lo + 3000] * scale, ids[lo:lo + 3000])
    q, i, s = best.rows(np.arange(len(qm)))
    pairs = np.einsum("ij,kj->ik", qm, x * scale)
    for a in range(len(qm)):
        got = s[q == a]
        assert len(got) == 20 and np.allclose(got, np.sort(np.round(pairs[a], K.SCORE_DIGITS))[::-1][:20], rtol=1e-12, atol=2e-9)


def test_most_pairs_are_not_scored_in_double(monkeypatch):
    rng = np.random.default_rng(4)
    qm, x = rng.normal(size=(512, 8)), rng.normal(size=(40000, 8))
    best, seen = K._Best(qm, 10), []
    scored = K._BestPart.scored
    monkeypatch.setattr(K._BestPart, "scored", lambda self, *a: (seen.append(scored(self, *a)), seen[-1])[1])
    best.add(x, np.arange(len(x)))
    assert sum(len(f[0]) for f in seen if f is not None) < qm.shape[0] * len(x) / 100
    assert sum(f is None for f in seen) <= 2


def test_places_of_a_mask():
    for n in (0, 5, 8, 4096):
        mask = np.random.default_rng(5).random((3, n)) < 0.05
        assert K._few_places(mask).tolist() == np.flatnonzero(mask).tolist()


def test_tiles_are_dealt_evenly_whatever_the_shuffle_partitions(spark):
    """200 shuffle partitions were 200 tasks for some 40 tiles, of which several fell into one."""
    rows = spark.range(3000).select(F.lit(1).alias("side"), (F.col("id") % 5).cast("string").alias("g"),
                                    F.lit(None).cast("bigint").alias("qid"), F.col("id").alias("docid"),
                                    F.array(F.col("id") + 1.0, F.lit(1.0)).alias("v"))
    q = rows.where("docid < 100").select(F.lit(0).alias("side"), "g", F.col("docid").alias("qid"),
                                         F.lit(None).cast("bigint").alias("docid"), "v")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        scores = R.tiled_scores(q.unionByName(rows), q.select("g"), 3, 2, "bigint", "bigint", True)
        per_task = [n for n in scores.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    cores = spark.sparkContext.defaultParallelism
    assert len(per_task) == 4 * cores and sum(n > 0 for n in per_task) == min(4 * cores, 5 * min(8, cores))


def test_vectors_of_texts_that_occur_once_are_not_shuffled(spark, sf, monkeypatch):
    import pickle

    from vectorloom.plans import evaluation as E
    m = G.model_artifact(spark, sf, "turbo-lloyd-1")
    v = G.vocab(spark, sf, m)
    words = [r.word for r in v.limit(9).collect()]
    once = spark.createDataFrame([(i, " ".join(words[i:])) for i in range(8)] + [(None, words[0])], "text_id bigint, text string")
    monkeypatch.setattr(X, "SMALL_TEXTS_BYTES", 0)
    held = X.sent_lexicons({"": m}, v)
    assert b"vectorloom" not in pickle.dumps(held[0].value)       # read by workers without this package
    one = lambda df: sorted((r[0] is None, r[0], r[1]) for r in df.collect())       # noqa: E731
    enc = X.encode(once, m, v, held=held)
    assert "hashpartitioning" not in enc._jdf.queryExecution().executedPlan().toString()
    assert one(enc) == one(X.encode(once, m, v, held=held, repeats=True))
    twice = once.union(once.where("text_id = 3 or text_id is null"))
    some = X.encode(twice, m, v, held=held)
    assert "hashpartitioning" in some._jdf.queryExecution().executedPlan().toString()
    assert one(some) == one(X.encode(twice, m, v, held=held, repeats=True)) and some.count() == 9
    monkeypatch.setattr(X, "REPEATED_IDS", 1)
    assert one(X.encode(twice, m, v, held=held)) == one(some)
    # evaluations that share a lexicon do not read it again
    monkeypatch.setattr(E, "SMALL_TEXTS_BYTES", 0)
    monkeypatch.setattr(E, "sent_lexicons", None)
    q, p = E.encode_pair(m, v, once.withColumnRenamed("text_id", "qid"), once.withColumnRenamed("text_id", "docid"), held=held)
    assert q.count() == p.count() == 9
