"""Task scores on embeddings: Spearman (STS), pair average precision,
classification accuracy, and the per-task main score / average.

Ranks and cumulative counts need an order over a task's rows. Rows of equal value are
counted first, so a value is one row however many rows share it. The distinct (task, value)
rows are range-partitioned by value; each partition's totals, one row per task and partition,
are scanned and added to the running sums inside the partitions. No task's rows are sorted
or gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DIGITS = 6


def prefix_sums(counts: DataFrame, value: str, part: list[str], sums: list[str], desc: bool = False,
                partitions: int | None = None) -> DataFrame:
    """Adds ``before_<s>``: the sum of ``s`` over the rows of the group that come before the row's
    value (above it if ``desc``). ``counts`` has one row per group and value.

    The rows are range-partitioned by (group, value) and written; a group may span any number
    of partitions.
    """
    spark = counts.sparkSession
    order = F.desc(value) if desc else F.asc(value)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(counts.repartitionByRange(n, *part, order).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*part, "_p").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # range partitions are numbered in the order of the values; one row per group and partition
    earlier = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_p", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}")
                                           for s in sums])
    within = Window.partitionBy(*part, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in part] + [F.col("d._p") == F.col("o._p")]
    joined = dealt.alias("d").join(offsets.alias("o"), on)
    return joined.select("d.*", *[F.col(f"o._o_{s}") for s in sums]).select(
        *counts.columns, *[(F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(within), F.lit(0))).alias(f"before_{s}")
                           for s in sums])


def _ranks(counts: DataFrame, value: str, part: list[str], out: str) -> DataFrame:
    """(*part, value, out): the mean position of the rows of each value, from 1, ties sharing one."""
    per_value = counts.groupBy(*part, value).agg(F.sum("n").alias("n"))
    ranked = prefix_sums(per_value, value, part, ["n"])
    return ranked.select(*part, value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(out))


def _same(a: str, b: str, cols: list[str]):
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]


def avg_rank(df: DataFrame, col: str, part: list[str], out: str) -> DataFrame:
    """``df`` with the average rank (ties share the mean of their positions) of ``col`` within
    each ``part`` group. Null values get no rank."""
    if not part:
        raise ValueError("rank statistics need at least one group column (e.g. task)")
    known = df.where(F.col(col).isNotNull()).groupBy(*part, col).agg(F.count(F.lit(1)).alias("n"))
    ranks = _ranks(known, col, part, out)
    return df.alias("d").join(ranks.alias("r"), _same("d", "r", [*part, col]), "left").select("d.*", F.col(f"r.{out}"))


def spearman(df: DataFrame, x: str, y: str, part: list[str]) -> DataFrame:
    """Spearman correlation of x and y per group (average ranks for ties).

    Pairs with a null value are left out. Works on the distinct (group, x, y) with their
    numbers; the correlation is of the ranks weighted by them. A group whose x or y has one
    value only has no correlation (null).
    """
    if not part:
        raise ValueError("rank statistics need at least one group column (e.g. task)")
    pairs = cut_lineage(df.dropna(subset=[x, y]).groupBy(*part, x, y).agg(F.count(F.lit(1)).alias("n")), "pairs")
    rx, ry = _ranks(pairs, x, part, "rx"), _ranks(pairs, y, part, "ry")
    r = pairs.alias("p").join(rx.alias("a"), _same("p", "a", [*part, x])).join(ry.alias("b"), _same("p", "b", [*part, y]))
    # ranks are halves around the group's mean rank (n + 1) / 2, which is taken off first
    r = r.select(*[F.col(f"p.{c}").alias(c) for c in part], F.col("p.n").alias("n"), "rx", "ry")
    mean = r.groupBy(*part).agg(((F.sum("n") + 1) / 2.0).alias("mean"))
    c = r.alias("p").join(mean.alias("m"), _same("p", "m", part)).select(
        *[F.col(f"p.{k}").alias(k) for k in part], "n", (F.col("rx") - F.col("mean")).alias("dx"),
        (F.col("ry") - F.col("mean")).alias("dy"))
    s = c.groupBy(*part).agg(F.sum(F.col("n") * F.col("dx") * F.col("dy")).alias("xy"),
                             F.sum(F.col("n") * F.col("dx") * F.col("dx")).alias("xx"),
                             F.sum(F.col("n") * F.col("dy") * F.col("dy")).alias("yy"))
    apart = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    return s.select(*part, F.round(F.when(apart > 0, F.col("xy") / apart), DIGITS).alias("spearman"))


def average_precision(df: DataFrame, score: str, label: str, part: list[str]) -> DataFrame:
    """AP of a score against 0/1 labels; equal scores share one threshold.

    At a value, precision counts the rows and positives with at least that score; each of the
    value's positives adds it once. Rows without score or label are left out.
    """
    if not part:
        raise ValueError("rank statistics need at least one group column (e.g. task)")
    per_value = df.dropna(subset=[score, label]).groupBy(*part, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) > 0).cast("bigint")).alias("tp"))
    c = prefix_sums(per_value, score, part, ["n", "tp"], desc=True)
    found = (F.col("before_tp") + F.col("tp")) / (F.col("before_n") + F.col("n"))
    return c.groupBy(*part).agg(F.round(F.coalesce(
        F.sum(F.when(F.col("tp") > 0, F.col("tp") * found)) / F.sum("tp"), F.lit(0.0)), DIGITS).alias("average_precision"))


def main_score(task_scores: DataFrame) -> DataFrame:
    """Per task: the score of the first subset of split 'test', else of the first split.

    A chosen subset without a score counts 0.
    """
    pref = F.struct((F.col("split") != "test").alias("_nt"), F.col("split_pos"), F.col("subset_pos"))
    return task_scores.groupBy("task").agg(
        F.coalesce(F.min_by("score", pref), F.lit(0.0)).alias("main_score"))


def task_average(main_scores: DataFrame) -> DataFrame:
    return main_scores.agg(F.round(F.coalesce(F.avg("main_score"), F.lit(0.0)), DIGITS).alias("task_avg"),
                           F.count(F.lit(1)).cast("bigint").alias("num_tasks"))


def classification_accuracy(df: DataFrame, label: str, vec: str = "embedding",
                            key: str = "row_id", test_mod: int = 5, seed: int = 42) -> DataFrame:
    """Logistic regression on the vectors; rows with hash(key) % test_mod == 0 are
    held out. One row: accuracy and test rows. Rows without label or vector are left out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    data = df.dropna(subset=[label, vec]).select(key, F.col(label).cast("double").alias("label"),
                                                 array_to_vector(vec).alias("features"))
    held = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(test_mod)) == 0
    train, test = data.where(~held), data.where(held)
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(train)
    pred = model.transform(test)
    return pred.agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), DIGITS)
                    .alias("accuracy"), F.count(F.lit(1)).cast("bigint").alias("test_rows"))
