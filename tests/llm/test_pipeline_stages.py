"""Stages of the pipeline on rows in any order and on tables without rows."""
import random

from test_llm import SCHEMA, prose

from vectorloom.llm import language_id


def test_language_limits_follow_the_rows_alone(spark):
    import corpus_pipeline
    rng = random.Random(2)
    lex = {"en": [f"th{i}e" for i in range(90)], "xx": [f"qz{i}u" for i in range(90)], "yy": [f"ob{i}w" for i in range(90)]}
    data = [(i, prose(rng, rng.randrange(1, 40), lex[k]), k) for i in range(900) for k in [rng.choice([*lex])]]
    df = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in data], SCHEMA)
    model = language_id.fit(*language_id.training_sample(df))
    got = [corpus_pipeline.language_limits(df.repartition(n, "text"), model) for n in (1, 5, 13)]
    assert got[0] == got[1] == got[2]
    scored = language_id.predict(df.filter(language_id.held_out("doc_id")), model).filter("lang_pred = lang").collect()
    for lang, limit in [*got[0][0].items(), (None, got[0][1])]:
        scores = sorted(r.score for r in scored if lang in (None, r.lang))
        rank = max(0, -(-len(scores) // 1000) - 1)                   # the least rank that holds the quantile
        steps = corpus_pipeline.SCORE_STEPS
        assert limit == int(scores[rank] * steps) / steps
    assert corpus_pipeline.language_limits(df.limit(0), model) == ({}, 0.0)


def test_stages_on_empty_tables_and_null_rows(spark, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, "s", 0)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nulls.limit(0), str(tmp_path)).collect() == [], name
        left = stage(spark, nulls, str(tmp_path)).collect()
        assert len(left) == (0 if name == "language_id" else 3), name
