"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

Equal vectors of a label are folded into one representative first, so a group of
thousands of copies is one row. A rotation for balanced binary codes is learned
on a bounded sample; every representative gets a code. The code is split into
``tables`` substrings; each row is entered in each table under its substring and
under all substrings one bit away, so two rows whose substrings differ in at most
two bits meet. Of the places where a pair meets only one counts, which is
computed from the two codes, so no pair is made twice. Pairs within
``max_distance`` bits are reranked by the cosine of the original vectors in
double precision.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 7
                   ) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): the sign pattern of (x - mean) @ projection is the code."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    basis = axes[:, ::-1][:, :bits]
    v = x @ basis
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, basis @ r


def _filled(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """The vectors, scaled to norm 1; shorter ones are filled up with zeros, which turns no angle."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(lengths), d))
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    x[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - starts] = flat
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _codes(reps: DataFrame, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    d, bits = projection.shape
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _filled(b.column(2), d)
            code = np.where((x - mean) @ projection >= 0, weights, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(code.view(np.int64))], names=[*b.schema.names, "code"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(run, f"{schema}, code bigint")


def _finite(vector: str) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def _dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def near_links(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id",
               vector_col: str = "embedding", label_col: str = "label", sample_rows: int = 10_000,
               tables: int = 4, max_distance: int = 18) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: uid, id, rep (least id of the rows with the same label and direction), copies; only
    rows that can link. links: a < b, one row per pair of representatives of a label found
    with a cosine of at least ``threshold``.

    ``vectors`` has a column ``uid`` that no two rows share. The rotation is learned on about
    ``sample_rows`` rows picked by a hash of the vector; codes, tables and rerank cover every row.
    Vectors link only with vectors of their own length. Zero vectors and those with null or
    non-finite components, rows with a null label and rows with a null id link with nothing.
    Vectors are scaled by their largest component first, so no product overflows.
    """
    size = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    good = (vectors.select("uid", F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
                           F.col(f"`{vector_col}`").alias("v"))
            .filter(F.col("label").isNotNull() & F.col("id").isNotNull() & _finite("v"))
            .withColumn("v", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)))
            .withColumn("size", size).filter("size > 0")
            .withColumn("v", F.transform("v", lambda x: x / F.col("size")))
            .select("uid", "id", F.struct("label", F.size("v").alias("d")).alias("label"), "v"))
    spark = vectors.sparkSession
    rows, d = good.agg(F.count("*"), F.max("label.d")).first()
    if not rows:
        none = spark.createDataFrame([], "uid bigint, id bigint, rep bigint, copies bigint")
        return none, spark.createDataFrame([], "a bigint, b bigint")
    # a representative is a row: ids may repeat over different vectors
    reps = good.groupBy("label", "v").agg(F.min(F.struct("id", "uid")).alias("least"), F.count("*").alias("copies"))
    reps = reps.select(F.col("least.uid").alias("rep"), "label", "v", "copies")

    share = min(1.0, sample_rows / rows)
    picked = reps.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v")
    sample = _filled(picked.limit(2 * sample_rows).toArrow().column("v"), d)
    bits = min(64, d)
    mean, projection = learn_rotation(sample, bits)
    coded = cut_lineage(_codes(reps, mean, projection), "codes")

    width = -(-bits // tables)
    masks = [0, *(1 << k for k in range(width))]
    entry = F.array(*(F.struct(F.lit(t).alias("t"),
                               F.shiftrightunsigned("code", t * width).bitwiseAND((1 << width) - 1).alias("own"))
                      for t in range(tables)))
    entered = (coded.select("rep", "label", "code", F.explode(entry).alias("e"))
               .select("rep", "label", "code", "e.t", "e.own",
                       F.explode(F.array(*(F.lit(m) for m in masks))).alias("m"))
               .select("rep", "label", "code", "t", F.col("own").bitwiseXOR(F.col("m")).cast("int").alias("key")))
    part = lambda c, t: f"(shiftrightunsigned({c}, {t * width}) & {(1 << width) - 1})"
    x, y = entered.alias("x"), entered.alias("y")
    diff = "(x.code ^ y.code)"
    first = F.expr("case " + " ".join(f"when bit_count({part(diff, t)}) <= 2 then {t}"
                                      for t in range(tables)) + " end")
    met = (x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.t") == F.col("y.t"))
                  & (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep"))
                  & F.expr(f"bit_count{diff} <= {max_distance}") & (first == F.col("x.t")))
           .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), "x.key",
                   F.expr("case x.t " + " ".join(f"when {t} then {part('x.code', t)}" for t in range(tables))
                          + " end").alias("p"),
                   F.expr("case x.t " + " ".join(f"when {t} then {part('y.code', t)}" for t in range(tables))
                          + " end").alias("q")))
    # the one key that counts: the common substring, the lesser of two that differ in one
    # bit, or the first with the lowest differing bit turned
    once = F.expr("case bit_count(p ^ q) when 0 then p when 1 then least(p, q) "
                  "else p ^ ((p ^ q) & -(p ^ q)) end")
    pairs = met.filter(F.col("key") == once).select("a", "b")
    vecs = coded.select("rep", "v")
    va = vecs.select(F.col("rep").alias("a"), F.col("v").alias("va"))
    vb = vecs.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    cosine = _dot("va", "vb") / (F.sqrt(_dot("va", "va")) * F.sqrt(_dot("vb", "vb")))
    links = (pairs.join(va, "a").join(vb, "b").filter(cosine >= F.lit(threshold)).select("a", "b"))
    members = good.join(coded.select("rep", "label", "v", "copies"), ["label", "v"]).select("uid", "id", "rep", "copies")
    return members, cut_lineage(links, "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", **options) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept. See ``near_links``.

    n_links counts the other rows linked directly, copies included; component_id is the least
    id of the rows reachable by links. A row that links with nothing is its own component.
    Rows that repeat, and rows of one id with different vectors, each count and give a row. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = cut_lineage(vectors.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, vector_col, label_col))],
                                      F.monotonically_increasing_id().alias("uid")), "vectors")
    members, links = near_links(rows, id_col=id_col, vector_col=vector_col, label_col=label_col, **options)
    members = cut_lineage(members, "vector_members")
    reps = members.groupBy("rep").agg(F.min("id").alias("least"), F.first("copies").alias("copies"))
    both = links.union(links.select("b", "a"))
    others = (both.join(reps.select(F.col("rep").alias("b"), "copies"), "b")
              .groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others")))
    of = components(links).select(F.col("node").alias("rep"), F.col("component_id").alias("group"))
    named = reps.join(of, "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    found = (members.join(named.select("rep", "group"), "rep").join(least, "group").join(others, "rep", "left")
             .select("uid", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = rows.select(F.col(f"`{id_col}`"), "uid").join(found, "uid", "left")
    component = F.coalesce("component_id", F.col(f"`{id_col}`"))
    return out.select(F.col(f"`{id_col}`"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.cast("bigint").alias("component_id"), (component == F.col(f"`{id_col}`")).alias("kept"))
