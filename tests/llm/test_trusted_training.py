from vectorloom.llm import kneser_ney


def test_quality_model_learns_from_all_trusted_documents(spark, monkeypatch):
    """About 20,000 of them before, by a hash of the id."""
    docs = spark.range(21_000).selectExpr("id as doc_id", "concat('text ', id % 7) as text", "'en' as lang")
    labels = spark.range(21_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    learned, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda t, order: learned.append(t.count()) or train(t, order))
    assert kneser_ney.classify(docs, labels, order=2).count() == 21_000
    assert learned == [21_000]


def test_texts_are_not_shuffled_to_the_labels(spark, monkeypatch):
    from vectorloom.llm import kneser_ney
    plans, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda texts, *rest: plans.append(
        texts._jdf.queryExecution().executedPlan().toString()) or train(texts, *rest))
    docs = spark.createDataFrame([(i, "a b c", "en") for i in range(20)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert kneser_ney.classify(docs, labels).count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
