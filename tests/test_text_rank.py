import numpy as np
from pyspark.sql import functions as F

from vectorloom.operators import rank as R
from vectorloom.operators import relevance as M
from vectorloom.operators.text import build_vocab, encode
from vectorloom.plans import registry
from vectorloom.sources import testdata as T


def _texts(spark):
    rows = [(1, "hello world"), (2, "testing"), (3, "foo bar"), (4, ""), (5, None), (6, "hello world")]
    return spark.createDataFrame(rows, "text_id bigint, text string")


def _model_vocab(spark, sf):
    m = registry.recipe(spark, sf, "turbo-lloyd-1")
    corpus = T.texts(spark, sf).unionByName(
        _texts(spark).withColumn("lang", F.lit("xx")))
    return m, build_vocab(corpus, m.num_rows)


def test_encode_shape_norm_empty(spark, sf):
    m, v = _model_vocab(spark, sf)
    w = [r["word"] for r in v.orderBy("token_id").limit(6).collect()]
    rows = [(1, f"{w[0]} {w[1]}"), (2, w[2].upper()), (3, f"{w[3]}, {w[4]}! {w[5]}"), (4, ""),
            (5, None), (6, f"{w[0]}  {w[1]}."), (7, "zzqqxv")]
    texts = spark.createDataFrame(rows, "text_id bigint, text string")
    out = {r["text_id"]: np.array(r["embedding"]) for r in encode(texts, m, v).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6, 7]
    for t in (1, 2, 3):
        assert len(out[t]) == m.dim and abs(np.linalg.norm(out[t]) - 1) < 1e-6
    assert not out[4].any() and not out[5].any() and not out[7].any()
    assert np.array_equal(out[1], out[6])
    assert not np.allclose(out[1], out[2])


def test_encode_independent_of_partitioning(spark, sf):
    m, v = _model_vocab(spark, sf)
    docs = T.texts(spark, sf)
    a = {r[0]: r[1] for r in encode(docs.repartition(1), m, v).collect()}
    b = {r[0]: r[1] for r in encode(docs.repartition(8), m, v).collect()}
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k], atol=1e-12) for k in a)


def test_topk_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    docs = rng.standard_normal((300, 8))
    docs[10] = docs[20] = docs[30]           # exact ties, broken by docid
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    qs = np.vstack([docs[30], rng.standard_normal((4, 8))])
    qs /= np.linalg.norm(qs, axis=1, keepdims=True)
    ddf = spark.createDataFrame([(i, [float(v) for v in docs[i]]) for i in range(300)],
                                "docid bigint, embedding array<double>").repartition(5)
    qdf = spark.createDataFrame([(i, [float(v) for v in qs[i]]) for i in range(5)],
                                "qid bigint, embedding array<double>")
    got = R.topk(qdf, ddf, 7, 8).orderBy("qid", "rank").collect()
    s = np.round(qs @ docs.T, 9)
    for q in range(5):
        order = sorted(range(300), key=lambda j: (-s[q, j], j))[:7]
        assert [r["docid"] for r in got if r["qid"] == q] == order
    assert [r["docid"] for r in got if r["qid"] == 0][:3] == [10, 20, 30]
    self_sim = [r["score"] for r in got if r["qid"] == 0][0]
    assert abs(self_sim - 1.0) < 1e-6


def _ndcg(rels, k):
    dcg = sum(r / np.log2(i + 2) for i, r in enumerate(rels[:k]))
    ideal = sorted(rels, reverse=True)[:k]
    idcg = sum(r / np.log2(i + 2) for i, r in enumerate(ideal))
    return dcg / idcg if idcg > 0 else 0.0


def test_metrics_match_definitions(spark):
    rng = np.random.default_rng(5)
    ranked, qrels = [], []
    for q in range(6):
        docs = rng.permutation(40)[:15]
        for rank, d in enumerate(docs, 1):
            ranked.append((q, int(d), rank, 0.0))
        for d in rng.permutation(40)[:6]:
            qrels.append((q, int(d), int(rng.integers(0, 3))))
    rdf = spark.createDataFrame(ranked, "qid bigint, docid bigint, rank int, score double")
    qdf = spark.createDataFrame(qrels, "qid bigint, docid bigint, rel int")
    topics = spark.createDataFrame([(q,) for q in range(7)], "qid bigint")
    got = {r["qid"]: r for r in M.query_scores(topics, rdf, M.Judgments(qrels=qdf), (10,), (10, 3)).collect()}
    for q in range(6):
        qr = {d: r for (qq, d, r) in qrels if qq == q}
        rels = [qr.get(d, 0) for (qq, d, _, _) in ranked if qq == q]
        nrel = sum(1 for r in qr.values() if r > 0)
        assert abs(got[q]["ndcg_10"] - _ndcg(rels, 10)) < 1e-12
        if nrel:
            assert abs(got[q]["recall_3"] - sum(1 for r in rels[:3] if r > 0) / nrel) < 1e-12
    assert 6 not in got        # unjudged query is not scored


def test_topk_split_query_blocks(spark, monkeypatch):
    """A query side larger than one broadcast block is split; results unchanged."""
    rng = np.random.default_rng(11)
    docs = rng.standard_normal((120, 4))
    qs = rng.standard_normal((30, 4))
    ddf = spark.createDataFrame([(i, [float(v) for v in docs[i]]) for i in range(120)],
                                "docid bigint, embedding array<double>")
    qdf = spark.createDataFrame([(i, [float(v) for v in qs[i]]) for i in range(30)],
                                "qid bigint, embedding array<double>")
    one = {tuple(r) for r in R.topk(qdf, ddf, 5, 4).collect()}
    monkeypatch.setattr(R, "QUERY_BLOCK_BYTES", 8 * (8 * 4 + 64 + 16 * 5))   # 8 queries per block
    split = {tuple(r) for r in R.topk(qdf, ddf, 5, 4).collect()}
    assert one == split and len(one) == 150


def test_topk_of_string_ids_within_groups(spark):
    """Ids of any text; no ranked row crosses groups; ties go by id; a null group meets nothing."""
    import numpy as np
    rng = np.random.default_rng(1)
    vec = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=4))     # noqa: E731
    rows = [(f"{i % 7}#{i}", "ab"[i % 2], vec()) for i in range(60)]
    rows += [(f"copy{i}", "a", rows[0][2]) for i in range(5)] + [("lost", None, vec())]
    queries = [("q1", "a", rows[0][2]), ("q#2", "b", vec()), ("none", "c", vec()), ("null", None, vec())]
    schema = "{} string, lang string, embedding array<double>"
    got = R.topk(spark.createDataFrame(queries, schema.format("qid")),
                 spark.createDataFrame(rows, schema.format("docid")).repartition(3), 6, 4, group="lang")
    want = []
    for qid, lang, q in queries:
        near = sorted((-round(float(np.dot(q, v)), 9), d) for d, g, v in rows if lang and g == lang)[:6]
        want += [(qid, lang, d, i + 1, -s) for i, (s, d) in enumerate(near)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
