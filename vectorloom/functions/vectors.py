"""Column expressions over fixed-width vectors.

Vectors are stored as ``array<double>`` (``array<float>`` on input is cast).
Row-level vector math uses higher-order functions (``transform``,
``aggregate`` with a finish lambda, ``zip_with``): the expression stays the
same small size for any width D, so generated code never approaches the JVM's
method-size limits. Column-wise sums across rows use D plain ``sum``
aggregates, which Spark runs as a partial aggregation before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c: str | Column) -> Column:
    return col(c).cast("array<double>")




def tree_sum(terms: Sequence[Column]) -> Column:
    """Balanced sum of column terms (keeps the expression depth at log2 n)."""
    terms = list(terms)
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        nxt = [terms[i] + terms[i + 1] for i in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0]












def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element transform).

    Keeps the optimizer from inlining an expensive expression into a lambda,
    where it would be re-evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sq_norm_hof(c: str | Column) -> Column:
    return F.aggregate(as_double_array(c), F.lit(0.0), lambda a, x: a + x * x)


def l2_normalise_expr(c: str | Column, floor: float = NORM_FLOOR) -> Column:
    """row / max(||row||, floor); the norm is folded once per row (finish lambda)."""
    def body(v):
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x,
                           lambda a: F.transform(v, lambda x: x / F.greatest(F.sqrt(a), F.lit(floor))))
    if isinstance(c, str):
        return body(as_double_array(c))
    return let(as_double_array(c), body)


def l2_normalise_df(df: DataFrame, c: str, d: int | None = None, out: str | None = None,
                    floor: float = NORM_FLOOR) -> DataFrame:
    out = out or c
    rest = [x for x in df.columns if x not in (c, out)]
    return df.select(*rest, l2_normalise_expr(c, floor).alias(out))


def row_norm_expr(c: str | Column, d: int | None = None, floor: float | None = NORM_FLOOR) -> Column:
    n = F.sqrt(sq_norm_hof(c))
    return F.greatest(n, F.lit(floor)) if floor is not None else n


def dot_expr(a: str | Column, b: str | Column, d: int | None = None) -> Column:
    prod = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda s, v: s + v)


def scale_expr(c: str | Column, factor: Column) -> Column:
    return F.transform(as_double_array(c), lambda x: x * factor)


def sq_dist_expr(a: str | Column, b: str | Column) -> Column:
    diff = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda s, v: s + v)


def sum_vectors(df: DataFrame, key: str | list[str], c: str, d: int,
                extra: list[Column] | None = None) -> DataFrame:
    """Element-wise sum of a vector column per key: D plain ``sum`` aggregates
    (partial aggregation before the shuffle), reassembled into an array."""
    keys = [key] if isinstance(key, str) else list(key)
    v = F.col(c)
    agg = df.groupBy(*keys).agg(*(extra or []), *[F.sum(v[i]).alias(f"_s{i}") for i in range(d)])
    others = [x for x in agg.columns if not x.startswith("_s") or not x[2:].isdigit()]
    return agg.select(*others, F.array(*[F.col(f"_s{i}") for i in range(d)]).alias(c))




def long_form(df: DataFrame, key: str, c: str, digits: int = 6,
              value: str = "value") -> DataFrame:
    """(key, dim, value) rows with rounded doubles: the comparison form."""
    return (df.select(key, F.posexplode(as_double_array(c)).alias("dim", "_x"))
              .select(key, F.col("dim").cast("int").alias("dim"),
                      F.round("_x", digits).alias(value)))
