"""Tiled ranking and evaluation: groups with equal ids, no work while planning, one plan for many
models, runs that resume, cached eval sets, files of many languages."""
import contextlib
import gzip
import io
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import rank as R
from vectorloom.operators import relevance as M
from vectorloom.operators import reports as RP
from vectorloom.plans import evaluation as E
from vectorloom.plans import progress as PR
from vectorloom.plans import registry, registry_reports
from vectorloom.sources import store
from vectorloom.sources import testdata as T
from vectorloom.sources import trec as TR


def _formatted(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _unit(rng, n, d):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_equal_query_ids_of_two_groups_keep_their_own_rows(spark, monkeypatch, block):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(R, "QUERY_BLOCK_BYTES", block * (8 * 6 + 64 + 16 * 4))
    rows = [(i, "de" if i % 3 else "en", v.tolist()) for i, v in enumerate(_unit(rng, 200, 6))]
    queries = [(i % 9, "de" if i < 9 else "en", v.tolist()) for i, v in enumerate(_unit(rng, 18, 6))]
    queries += [(None, "de", rows[0][2]), (50, "xx", rows[0][2]), (51, None, rows[0][2]), (52, "en", None)]
    got = R.topk(spark.createDataFrame(queries, "qid bigint, lang string, embedding array<double>"),
                 spark.createDataFrame(rows, "docid bigint, lang string, embedding array<double>").repartition(4),
                 4, 6, group="lang")
    want = []
    for q, lang, v in queries[:18]:
        near = sorted((-round(float(np.dot(v, w)), 9), i) for i, g, w in rows if g == lang)[:4]
        want += [(q, lang, i, n + 1) for n, (_, i) in enumerate(near)]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)


def test_no_sides_no_queries_no_rows(spark):
    schema = "{} bigint, embedding array<double>"
    none_q, none_r = spark.createDataFrame([], schema.format("qid")), spark.createDataFrame([], schema.format("docid"))
    one_q = spark.createDataFrame([(1, [1.0, 0.0])], schema.format("qid"))
    one_r = spark.createDataFrame([(1, [1.0, 0.0])], schema.format("docid"))
    assert R.topk(none_q, one_r, 3, 2).collect() == [] == R.topk(one_q, none_r, 3, 2).collect()
    assert [tuple(r) for r in R.similarity_matrix(one_q, one_r, 2).collect()] == [(1, 1, 1.0)]


def test_planning_runs_no_job_and_sends_no_query_to_the_driver(spark, sf):
    registry.QUERIES["topk_full"](spark, sf)          # vocabulary and model are made
    sc = spark.sparkContext
    sc.setJobGroup("planning", "planning")
    try:
        df = registry.QUERIES["topk_full"](spark, sf)
        plan = _formatted(df)
        assert not sc.statusTracker().getJobIdsForGroup("planning")
    finally:
        sc.setJobGroup("default", "default")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
    assert plan.count("BroadcastExchange") <= 2 * 4          # the lexicon's joins of both sides, no queries


def test_a_language_without_judged_queries_has_a_row_of_zeros(spark, sf):
    m, v = registry._model_and_vocab(spark, sf)
    topics = T.topics_b(spark, sf).unionByName(spark.createDataFrame(
        [(3, "lonely words", "xx", "none")], "qid bigint, text string, lang string, source string"))
    for run in (E.eval_pooled, E.eval_full):
        rows = {r.lang: r for r in run(m, v, topics, T.passages_b(spark, sf), T.judgments_b(spark, sf), ("lang",)).collect()}
        assert rows["xx"].ndcg_10 == 0.0 and rows["xx"].num_queries == 0 and rows["en"].num_queries > 0
        assert getattr(rows["xx"], "total_passages", 0) == 0


def test_metrics_of_equal_ids_in_two_languages(spark):
    ranked = spark.createDataFrame([("a", "q", "d1", 1), ("a", "q", "d2", 2), ("b", "q", "d1", 1), ("b", "q", "d2", 2)],
                                   "lang string, qid string, docid string, rank int")
    qrels = spark.createDataFrame([("a", "q", "d1", 1), ("b", "q", "d2", 1), ("b", "q", "d9", 1)],
                                  "lang string, qid string, docid string, rel int")
    topics = spark.createDataFrame([("a", "q"), ("b", "q"), ("c", "q")], "lang string, qid string")
    j = M.Judgments(qrels=qrels, by=("lang",))
    got = {r.lang: r for r in M.query_scores(topics, ranked, j, (10,), (2,), group_cols=("lang",)).collect()}
    assert set(got) == {"a", "b"} and got["a"].recall_2 == 1.0 and got["b"].recall_2 == 0.5
    ideal = {r.lang: r.ndcg_10 for r in M.query_scores(topics, ranked, j, (10,), (2,), ("lang",), ideal="qrels").collect()}
    assert ideal["a"] == 1.0 and abs(ideal["b"] - (1 / np.log2(3)) / (1 + 1 / np.log2(3))) < 1e-12
    rule = M.Judgments(query_keys=topics.withColumn("src", F.lit("s")), keys=("src",), by=("lang",), doc_keys=spark.createDataFrame(
        [("a", "d1", "s"), ("a", "d2", "t"), ("b", "d1", "t"), ("b", "d2", "s"), ("b", "d3", "s")],
        "lang string, docid string, src string"))
    rels = {(r.lang, r.docid): r.rel for r in M.ranked_rels(ranked, rule).collect()}
    assert rels == {("a", "d1"): 1, ("a", "d2"): 0, ("b", "d1"): 0, ("b", "d2"): 1}
    assert {(r.lang, r.num_relevant) for r in M.num_relevant(rule).collect()} == {("a", 1), ("b", 2)}


def test_model_grid_is_one_plan_and_equals_single_evaluations(spark, sf):
    grid = registry_reports._grid_plan(spark, sf)
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate" in line and "regexp_extract_all" in line]
    assert len(made) == 1
    rows = {(r.model, r.lang): r for r in grid.collect()}
    m, v = registry._model_and_vocab(spark, sf)
    for r in E.eval_pooled(m, v, T.topics_b(spark, sf), T.passages_b(spark, sf), T.judgments_b(spark, sf), ("lang",)).collect():
        same = rows["embeddings_turbo-lloyd-1", r.lang]
        assert abs(same.ndcg_10 - r.ndcg_10) < 1e-6 and same.num_queries == r.num_queries


def test_models_of_other_widths_and_texts_without_words(spark, sf):
    from vectorloom.operators import learn as L
    from vectorloom.operators.text import encode, encode_models
    m, v = registry._model_and_vocab(spark, sf)
    base = registry.base(spark, sf)
    models = {"a": base, "b": L.pca(base, 8)}
    texts = spark.createDataFrame([(1, "the and of"), (2, None), (3, ""), (4, "?? !!")], "text_id bigint, text string")
    got = {(r.model, r.text_id): np.array(r.embedding) for r in encode_models(texts, models, v).collect()}
    assert len(got) == 8
    for name, model in models.items():
        for r in encode(texts, model, v).collect():
            alone = np.array(r.embedding)
            assert np.allclose(got[name, r.text_id][:len(alone)], alone) and not got[name, r.text_id][len(alone):].any()


def test_a_run_that_stops_goes_on_with_the_rest(spark, tmp_path):
    asked = [(m, x) for m in "ab" for x in ("de", "en", "fr")]
    requested = spark.createDataFrame(asked, "model string, lang string")
    scored, log = [], str(tmp_path / "log")

    def score(model, lang):
        scored.append((model, lang))
        if len(scored) == 3:
            raise RuntimeError("stopped")
        if (model, lang) == ("a", "fr") and len(scored) < 8:
            raise FileNotFoundError(lang)
        time.sleep(0.01)
        return spark.createDataFrame([(float(len(scored)), 5)], "ndcg_10 double, n bigint")
    schema = "ndcg_10 double, n bigint"
    with pytest.raises(RuntimeError):
        PR.resume(spark, log, requested, schema, score)
    first = {(r.model, r.lang): r for r in PR.committed(spark, log, schema).collect()}
    assert set(first) == {("a", "de"), ("a", "en")} and all(r.seconds > 0 for r in first.values())
    os.makedirs(f"{log}/_writing-x/scores")            # a write that never ended
    again = {(r.model, r.lang): r for r in PR.resume(spark, log, requested, schema, score).collect()}
    assert set(again) == set(asked) - {("a", "fr")} and len(scored) == 7          # its files are missing
    assert all(again[k] == first[k] for k in first)
    assert scored[3:] == [("a", "fr"), ("b", "de"), ("b", "en"), ("b", "fr")]
    assert PR.resume(spark, log, requested, schema, score).count() == 6 and len(scored) == 8
    PR.resume(spark, log, requested, schema, score)
    assert len(scored) == 8


def test_eval_cache_hit_change_and_unfinished_write(spark, tmp_path):
    data, root, built = tmp_path / "in", str(tmp_path / "cache"), []
    data.mkdir()
    (data / "a.txt").write_text("one")

    def build():
        built.append(1)
        one = spark.createDataFrame([("de", len(built)), ("en", 7)], "lang string, n int")
        return one, one.drop("lang"), one
    load = lambda: [sorted(map(tuple, t.collect())) for t in TR.eval_cache(spark, root, [str(data)], build, "x")]
    first = load()
    assert load() == first and len(built) == 1
    assert os.path.isdir(f"{root}/{os.listdir(root)[0]}/topics/lang=de")
    (data / "b.txt").write_text("two")
    assert load() != first and len(built) == 2
    (data / "a.txt").write_text("other")
    key = store.fingerprint(spark, str(data))
    os.makedirs(f"{root}/_writing-{key}-x/topics")
    load()
    assert len(built) == 3
    kept = store.publish(spark, {"t": spark.range(3)}, str(tmp_path / "p"))
    store.publish(spark, {"t": spark.range(9)}, kept)
    assert spark.read.parquet(f"{kept}/t").count() == 3
    assert sorted(os.listdir(tmp_path)) == ["cache", "in", "p"]


def test_materialized_tables_follow_the_data(spark, tmp_path):
    from vectorloom.session import materialize
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    get = lambda: materialize(lambda: spark.read.parquet(path), ("follow", path), spark, "t", [path]).count()
    assert get() == 3
    spark.range(5).write.mode("append").parquet(path)
    assert get() == 8


def test_languages_from_files(spark, tmp_path):
    def put(table, lang, name, text):
        os.makedirs(tmp_path / table / f"lang={lang}", exist_ok=True)
        with (gzip.open if name.endswith("gz") else open)(tmp_path / table / f"lang={lang}" / name, "wt") as f:
            f.write(text)
    doc = lambda i, t: json.dumps({"docid": i, "title": None if i == "d1" else "T", "text": t}) + "\n"
    for lang in ("de", "en", "01"):
        put("topics", lang, "a.tsv", "7#1\told\n\n7#1\tnew\n8#1\tunjudged\n")
        put("topics", lang, "b.tsv", f"7#1\tin {lang}\n")
        put("qrels", lang, "a.tsv", "7#1\tQ0\td1\t0\n7#1\tQ0\td1\t1\n7#1\tbad\n")
        put("corpus", lang, "docs-0.jsonl.gz", doc("d1", f"{lang} one") + doc("d2", "stale") + doc("d2", "two"))
    put("qrels", "fr", "a.tsv", "1\tQ0\td1\t1\n")
    put("corpus", "fr", "docs-0.jsonl.gz", doc("d1", "fr"))
    got = TR.multi_language_load(spark, str(tmp_path), ["de", "01", "fr", "zz"])
    assert {tuple(r) for r in got["topics"].collect()} == {("de", "7#1", "in de"), ("01", "7#1", "in 01")}
    assert {tuple(r) for r in got["qrels"].collect()} == {("de", "7#1", "d1", 1), ("01", "7#1", "d1", 1)}
    assert {tuple(r) for r in got["passages"].collect()} == {
        (x, *p) for x in ("de", "01") for p in (("d1", f"{x} one"), ("d2", "T. two"))}
    assert {r.lang for r in got["missing"].collect()} == {"fr", "zz"}
    for name in ("qrels", "passages"):
        assert "dynamicpruning" in _formatted(got[name]), name


def test_read_corpus_of_an_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        TR.read_corpus(spark, str(tmp_path))


def test_flat_metrics_and_results_document(spark, tmp_path):
    rows = [("m", "de", 0.5, 10, 1.25), ("m", "fi", 0.25, 20, 2.0), ("k_x", "de", None, 10, 0.5)]
    per_lang = spark.createDataFrame(rows, "model string, lang string, ndcg_10 double, passages bigint, seconds double")
    flat = {(r.model, r.name): r.value for r in RP.flat_metrics(per_lang, ["ndcg_10", "passages", "seconds"]).collect()}
    assert flat["m", "ndcg_10_fi"] == 0.25 and flat["m", "seconds_de"] == 1.25 and flat["k_x", "ndcg_10_de"] == 0.0
    sizes = spark.createDataFrame([("m", 1.5, ["base"]), ("k_x", 0.5, ["base_2", "k_x"])],
                                  "model string, size_mb double, provenance array<string>")
    summary = {r.model: r.asDict() for r in RP.summary_table(per_lang, sizes, ["ndcg_10"]).collect()}
    assert summary["m"]["ndcg_10_fi"] == 0.25 and summary["k_x"]["ndcg_10_fi"] == 0.0 and summary["m"]["ndcg_10"] == 0.375
    docs = RP.results_json(RP.results_rows(per_lang, sizes, ["ndcg_10"]), "run", {"mode": "full"})
    one, = docs.collect()
    parsed = json.loads(one.json)
    assert parsed["metadata"]["label"] == "run" and parsed["metadata"]["mode"] == "full"
    assert [r["name"] for r in parsed["results"]] == ["k_x", "m"] and parsed["results"][0]["provenance"] == ["base_2", "k_x"]
    docs.write.text(str(tmp_path / "doc"))
    assert RP.read_results_json(spark, str(tmp_path / "doc")).count() == 2
    assert json.loads(RP.results_json(RP.results_rows(per_lang.limit(0), sizes, ["ndcg_10"])).first().json)["results"] == []
