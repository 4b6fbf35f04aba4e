"""End-to-end evaluation plans: encode -> rank -> label -> metrics.

Pooled mode ranks the judged queries against the pooled passages (top 10);
full mode ranks them against the whole corpus (top 100). With group columns
(e.g. lang) a query is its group and its id: it is ranked against the passages of
its own group only, and every group of the topics or the passages gets a row, zeros
where it has no judged query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators import relevance as M
from ..operators.tables import EmbeddingModel
from ..operators.text import SMALL_TEXTS_BYTES, Sent, encode, encode_models, estimated_bytes, lexicon, sent_lexicons


def held_for(model: EmbeddingModel, vocab: DataFrame, *texts: DataFrame) -> Sent | None:
    """The model's lexicon for the pooling kernel, None where all texts are small."""
    large = any(estimated_bytes(t) >= SMALL_TEXTS_BYTES for t in texts)
    return sent_lexicons({"": model}, vocab) if large else None


def encode_pair(model: EmbeddingModel, vocab: DataFrame, queries: DataFrame,
                passages: DataFrame, vocab_rows: int | None = None,
                group_cols=(), held: Sent | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode both sides with one lexicon: (qid, *group_cols, embedding) and (docid, ...).
    ``vocab_rows`` defaults to the model's token count, the size ``build_vocab`` is asked for;
    ``held`` is the model's lexicon (``sent_lexicons``) where several evaluations share it."""
    lx = lexicon(model, vocab)
    n = vocab_rows if vocab_rows is not None else model.tokens
    held = held if held is not None else held_for(model, vocab, queries, passages)

    def side(texts: DataFrame, key: str) -> DataFrame:
        keyed = texts.select(F.struct(key, *group_cols).alias("text_id"), "text")
        return encode(keyed, model, vocab, lex=lx, vocab_rows=n, held=held).select("text_id.*", "embedding")

    return side(queries, "qid"), side(passages, "docid")


def groups_of(topics: DataFrame, passages: DataFrame, group_cols) -> DataFrame | None:
    """Every group of either side, to give groups without judged queries a row."""
    return topics.select(*group_cols).union(passages.select(*group_cols)).distinct() if group_cols else None


def eval_pooled(model: EmbeddingModel, vocab: DataFrame, topics: DataFrame,
                passages: DataFrame, j: M.Judgments, group_cols=(), k: int = 10) -> DataFrame:
    """nDCG@10, recall@10, recall@3, num_queries, skipped over the pooled set."""
    jq = M.judged_queries(topics, j)
    q, p = encode_pair(model, vocab, jq, M.pool(passages, j), group_cols=group_cols)
    ranked = R.topk(q, p, k, model.dim, group=group_cols, sizes=jq)
    scores = M.query_scores(topics, ranked, j, ks_ndcg=(10,), ks_recall=(10, 3), group_cols=group_cols)
    return M.summarise(scores, group_cols, ks_ndcg=(10,), ks_recall=(10, 3),
                       groups=groups_of(topics, passages, group_cols))


def eval_full(model: EmbeddingModel, vocab: DataFrame, topics: DataFrame,
              passages: DataFrame, j: M.Judgments, group_cols=(), k: int = 100,
              held: Sent | None = None) -> DataFrame:
    """nDCG@10, recall@100, num_queries, total_passages, skipped over the full corpus."""
    jq = M.judged_queries(topics, j)
    q, p = encode_pair(model, vocab, jq, passages, group_cols=group_cols, held=held)
    ranked = R.topk(q, p, k, model.dim, group=group_cols, sizes=jq)
    scores = M.query_scores(topics, ranked, j, ks_ndcg=(10,), ks_recall=(k,), group_cols=group_cols)
    s = M.summarise(scores, group_cols, ks_ndcg=(10,), ks_recall=(k,), groups=groups_of(topics, passages, group_cols))
    if group_cols:
        total = passages.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("total_passages"))
        return s.join(total, list(group_cols), "left").withColumn(
            "total_passages", F.coalesce("total_passages", F.lit(0).cast("bigint")))
    return s.withColumn("total_passages", passages.agg(F.count(F.lit(1)).alias("n")).scalar())


def eval_models(models: dict[str, EmbeddingModel], vocab: DataFrame, topics: DataFrame, passages: DataFrame,
                j: M.Judgments, group_cols=(), k: int = 10, ks_ndcg=(10,), ks_recall=(10, 3),
                pooled: bool = True) -> DataFrame:
    """(model, *group_cols, metrics unrounded, num_queries, skipped) of many models in one plan.

    Queries and passages are read as one table of texts, which is split into words once; a
    word meets its vector of every model, one aggregate pools all (model, text), and one
    ranking compares the sides within (model, group).
    """
    jq = M.judged_queries(topics, j)
    chosen = M.pool(passages, j) if pooled else passages
    rtype = chosen.schema["docid"].dataType.simpleString()
    qtype = jq.schema["qid"].dataType.simpleString()
    texts = jq.select(F.struct(F.lit(R.QUERY).alias("side"), *group_cols, "qid",
                               F.lit(None).cast(rtype).alias("docid")).alias("text_id"), "text").unionByName(
        chosen.select(F.struct(F.lit(R.ROW).alias("side"), *group_cols, F.lit(None).cast(qtype).alias("qid"),
                               "docid").alias("text_id"), "text"))
    group = ["model", *group_cols]
    vectors = encode_models(texts, models, vocab).select("model", "text_id.*", "embedding")
    both = vectors.dropna(subset=list(group_cols)).select(
        "side", R.group_key(group).alias("g"), "qid", "docid", F.col("embedding").alias("v"))
    sizes = jq.select(F.explode(F.array(*map(F.lit, models))).alias("model"), *group_cols)
    d = max(m.dim for m in models.values())
    scores = R.tiled_scores(both, sizes.select(R.group_key(group).alias("g")), k, d, qtype, rtype, True)
    types = "model string" + (", " + R.group_types(jq, group_cols) if group_cols else "")
    ranked = R.merged(scores, k, group, types)
    per_query = M.query_scores(topics, ranked, j, ks_ndcg, ks_recall, group_cols, models=list(models))
    groups = groups_of(topics, passages, group_cols)
    if groups is not None:
        groups = groups.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return M.summarise(per_query, group, ks_ndcg, ks_recall, groups=groups, digits=None)


def eval_vectors(queries: DataFrame, rows: DataFrame, j: M.Judgments, d: int,
                 k: int = 10) -> DataFrame:
    """Retrieval metrics for vectors directly (no text): nearest rows per query."""
    ranked = R.topk(queries.select("qid", "embedding"), rows.select("docid", "embedding"), k, d)
    scores = M.query_scores(queries.select("qid"), ranked, j, ks_ndcg=(10,), ks_recall=(10,))
    return M.summarise(scores, (), ks_ndcg=(10,), ks_recall=(10,))


def eval_full_timed(model: EmbeddingModel, vocab: DataFrame, topics: DataFrame,
                    passages: DataFrame, j: M.Judgments, group_cols=(), k: int = 100) -> DataFrame:
    """``eval_full`` plus the wall-clock seconds of running it (``seconds``).

    The metrics table has one row per group (language), so it is collected and
    rebuilt with the elapsed time attached."""
    import time
    t0 = time.perf_counter()
    res = eval_full(model, vocab, topics, passages, j, group_cols, k)
    rows = res.collect()
    secs = round(time.perf_counter() - t0, 3)
    return res.sparkSession.createDataFrame(rows, res.schema).withColumn("seconds", F.lit(secs))
