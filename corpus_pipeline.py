"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet to the shared folder and read again as the next stage's documents. All but
the last return the columns of ``documents``:

1. language identification drops documents of no recognisable language: those that score
   below nearly all documents of the language found that the model has not learned from;
2. line deduplication deletes later repeats of line runs, and documents left without a line;
3. the Jaccard join keeps the document of least id of each group of near duplicates
   (five-word shingles, Jaccard 0.8 and more);
4. decontamination drops documents that overlap a benchmark item;
5. packing returns the pieces of all documents left, with their places in the sequences.

SQL cannot express the stages (ORACLE_SQL is None); tests hold each against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.llm import decontam, jaccard_join, language_id, line_dedup, packing
from vectorloom.session import cut_lineage

LANGUAGE_QUANTILE, SCORE_STEPS = 0.001, 1 << 14
NEAR_WORDS, NEAR_PERCENT = 5, 80       # op3 has a contract of its own: 4 words, 85 %


def language_limits(docs: DataFrame, model: language_id.KernelModel) -> tuple[dict[str, float], float]:
    """The least score of each language, and that of languages without held-out documents.

    A low quantile of the scores of all held-out documents that are found to be of the
    language of their label, down to the next of ``SCORE_STEPS`` steps; it is counted, so it is
    the same however the rows are partitioned. It follows the number of languages, as the scores
    do: a text that shares nothing with L learned languages scores about 1 / L. With one learned
    language every score is 1 and nothing but ``und`` is dropped.
    """
    held = docs.filter(language_id.held_out("doc_id") & F.col("lang").isNotNull()).select("lang", "text")
    right = language_id.predict(held, model, pred="__lang", score="__score").filter("__lang = lang")
    counts = (right.select("lang", F.floor(F.col("__score") * SCORE_STEPS).alias("step"))
              .groupingSets([["lang", "step"], ["step"]], "lang", "step").count())     # a row per language and step
    own = Window.partitionBy("lang")
    rows = (counts.withColumn("upto", F.sum("count").over(own.orderBy("step")))
            .withColumn("total", F.sum("count").over(own)).filter(F.col("upto") >= F.col("total") * LANGUAGE_QUANTILE)
            .groupBy("lang").agg(F.min("step") / SCORE_STEPS).collect())
    return {lang: limit for lang, limit in rows if lang is not None}, next((x for lang, x in rows if lang is None), 0.0)


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of a recognised language. Null texts and texts without a letter go (they are ``und``);
    a score at the limit stays; repeated rows are judged each; an empty table gives an empty result."""
    model = language_id.fit(*language_id.training_sample(docs))
    own, overall = language_limits(docs, model)
    limit = spark.createDataFrame(list(own.items()), "__l string, __limit double")      # a row per language
    found = (language_id.predict(docs, model, pred="__lang", score="__score")
             .join(F.broadcast(limit), F.col("__lang") == F.col("__l"), "left"))
    return found.filter((F.col("__lang") != language_id.UNKNOWN)
                        & (F.col("__score") >= F.coalesce("__limit", F.lit(overall)))).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with later repeats of line runs deleted; a row all of whose lines are deleted goes. Null
    texts stay as they are; of equal rows the first keeps its lines; an empty table stays empty."""
    left = line_dedup.dedup_lines(docs).filter("n_deleted = 0 or n_deleted < n_lines")
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id, a null one last, then the first.

    Rows are told apart by their place, not by doc_id, so a row that repeats goes as a copy and
    a unique text stays whatever other rows share its id. Texts without words link with nothing
    and stay. An empty table gives an empty result.
    """
    rows = docs.withColumn("__row", F.monotonically_increasing_id())       # docs is a written table
    groups = jaccard_join.join_components(rows, n=NEAR_WORDS, percent=NEAR_PERCENT, id_col="__row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    chosen = (rows.select("__row", "doc_id").join(groups.select("__row", "component_id"), "__row")
              .groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__row")))
    return rows.join(chosen, "__row", "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that overlap no benchmark item. Null texts overlap nothing; rows that share an id with
    a contaminated row go with it; without rows or items nothing changes."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places. A null text is an empty one; repeated rows are packed
    each; an empty table gives no piece."""
    return packing.pack(packing.cut_documents(docs))


STAGES = [("language_id", recognised_language), ("line_dedup", without_repeated_lines),
          ("jaccard_join", one_of_near_duplicates), ("decontamination", without_benchmark),
          ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
