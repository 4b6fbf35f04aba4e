"""Cosine scoring and top-K ranking.

Queries and rows meet in tiles. The queries of a group (e.g. a language) are dealt into
blocks of bounded size, its rows into lanes; each (group, block, lane) is one tile. A tile
holds its block in memory and streams the rows of its lane past it, keeping an exact running
top-K per query (ties by docid), so neither side has to fit anywhere as a whole and no query
row passes the driver. The numbers of blocks and lanes come from a count of the queries that
runs inside the same plan; no job runs while the plan is built. Each tile's survivors are
merged by a window ``row_number() <= K`` per (group, query), which Spark first applies in
every partition (WindowGroupLimit) and then after one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import kernels

# bytes of one block of queries: vectors (8 D a query) and running top-K state (16 K)
QUERY_BLOCK_BYTES = 64 * 1024 * 1024
# One more block of a group sends its rows once more, one more lane its queries and their k
# candidates (about 60 bytes each). Groups of few queries have one block, whatever their rows.
CANDIDATE_BYTES, BLOCK_QUERIES, ROWS_PER_QUERY = 60, 4096, 4
MANY_QUERIES = 32768
QUERY, ROW = 0, 1


def _names(group: str | Sequence[str] | None) -> list[str]:
    return [group] if isinstance(group, str) else list(group or ())


def group_key(group: Sequence[str]) -> Column:
    """One string for the values of the group columns, '' without any."""
    return F.to_json(F.struct(*group)) if group else F.lit("")


def one_side(df: DataFrame, side: int, key: str, vec: str, group: Sequence[str]) -> DataFrame:
    """(side, g, qid, docid, v) of queries or rows; those without id, vector or group are left out."""
    named = F.col(key).cast(kernels.key_type(df, key))
    return df.dropna(subset=[key, vec, *group]).select(
        F.lit(side).alias("side"), group_key(group).alias("g"), named.alias("id"),
        F.col(vec).cast("array<double>").alias("v"))


def narrow(v: Column) -> Column:
    """An array of numbers for a shuffle: in single precision where that loses nothing."""
    single = v.cast("array<float>")
    same = single.cast("array<double>").eqNullSafe(v)
    return F.struct(F.when(same, single).alias("single"), F.when(~same, v).alias("double"))


def widened(v: str) -> Column:
    return F.coalesce(F.col(f"{v}.single").cast("array<double>"), F.col(f"{v}.double"))


def tiled_scores(both: DataFrame, sizes: DataFrame, k: int | None, d: int, qtype: str, rtype: str,
                 grouped: bool, vector: Column | None = None) -> DataFrame:
    """(g, qid, docid, score): every tile's best ``k`` rows of each query (all rows if None).

    ``both`` is (side, g, qid, docid, v); ``sizes`` has a column ``g`` and as many rows per
    group as the group has queries. ``vector`` makes the vector from ``v`` behind the shuffle.
    """
    spark = both.sparkSession
    per_block = max(1, QUERY_BLOCK_BYTES // (8 * d + 64 + 16 * (k or 0)))
    cores = spark.sparkContext.defaultParallelism
    def shaped(sized: DataFrame) -> DataFrame:
        """``sized`` (n, share) with the blocks and lanes of a group."""
        # tiles of the group: its share, and a few where one more lane sends few queries again
        few = F.least(F.lit(min(8, cores)), F.ceil(F.lit(MANY_QUERIES) / F.col("n")))
        tiles = F.greatest(F.ceil(3 * cores * F.col("share")), few)
        if k is None:           # all pairs: tiles are even, and one a core sends each side least often
            tiles = F.lit(cores)
        vector = 8 * d + 64
        even = F.sqrt(tiles * ((CANDIDATE_BYTES * (k or 0) + vector) / (ROWS_PER_QUERY * vector)))
        even = F.least(F.greatest(F.round(even), F.lit(1)), tiles, F.ceil(F.col("n") / BLOCK_QUERIES))
        if k is None:
            even = F.lit(1)
        return sized.withColumn("blocks", F.greatest(F.ceil(F.col("n") / per_block), even).cast("int")) \
            .withColumn("lanes", F.ceil(tiles / F.col("blocks")).cast("int"))

    if grouped:          # rows of a group without queries go here
        counts = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        one = Window.partitionBy(F.lit(0))      # one row per group
        shapes = shaped(counts.withColumn("share", F.col("n") / F.sum("n").over(one)))
        # tiles are numbered through, so that each partition gets as many
        own_tiles = F.col("blocks") * F.col("lanes")
        first = F.sum(own_tiles).over(one.orderBy("g")) - own_tiles
        dealt = both.join(F.broadcast(shapes.select("g", "blocks", "lanes", first.alias("first"))), "g")
    else:
        dealt = shaped(both.withColumn("n", sizes.agg(F.count(F.lit(1)).alias("n")).scalar()).where("n > 0")
                       .withColumn("share", F.lit(1.0))).withColumn("first", F.lit(0))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    own = lambda n, *of: F.array(F.pmod(F.xxhash64(*of), n).cast("int"))
    is_query = F.col("side") == QUERY
    placed = (dealt
              .withColumn("b", F.explode(F.when(is_query, own(F.col("blocks"), "qid")).otherwise(up_to(F.col("blocks")))))
              .withColumn("lane", F.explode(F.when(is_query, up_to(F.col("lanes")))
                                            .otherwise(own(F.col("lanes"), "docid", "v"))))
              .withColumn("tile", F.col("first") + F.col("b") * F.col("lanes") + F.col("lane"))
              .select("g", "b", "lane", "side", "qid", "docid", "v", "tile"))
    parts = 4 * cores           # a tile is long work
    sent = placed.repartitionById(parts, F.pmod("tile", F.lit(parts)).cast("int")) \
        .drop("tile").sortWithinPartitions("g", "b", "lane", "side")
    if vector is not None:
        sent = sent.withColumn("v", vector)
    return sent.mapInArrow(kernels.tile_topk(k, d, qtype, rtype), f"g string, qid {qtype}, docid {rtype}, score double")


def _both(queries: DataFrame, rows: DataFrame, qkey: str, rkey: str, vec: str, group: Sequence[str]):
    qtype, rtype = kernels.key_type(queries, qkey), kernels.key_type(rows, rkey)
    q = one_side(queries, QUERY, qkey, vec, group).select(
        "side", "g", F.col("id").alias("qid"), F.lit(None).cast(rtype).alias("docid"), "v")
    r = one_side(rows, ROW, rkey, vec, group).select(
        "side", "g", F.lit(None).cast(qtype).alias("qid"), F.col("id").alias("docid"), "v")
    return q.unionByName(r), qtype, rtype


def merged(scores: DataFrame, k: int, group: Sequence[str], types: str = "") -> DataFrame:
    """(qid, *group, docid, rank, score): the first ``k`` of all tiles of each query."""
    w = Window.partitionBy("g", "qid").orderBy(F.desc("score"), F.asc("docid"))
    top = scores.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    if not group:
        return top.select("qid", "docid", "rank", "score")
    return top.withColumn("g", F.from_json("g", types)).select("qid", "g.*", "docid", "rank", "score")


def group_types(df: DataFrame, group: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group)


def topk(queries: DataFrame, rows: DataFrame, k: int, d: int, qkey: str = "qid", rkey: str = "docid",
         vec: str = "embedding", group: str | Sequence[str] | None = None,
         sizes: DataFrame | None = None) -> DataFrame:
    """(qid, *group, docid, rank, score): the k most similar rows per query.

    Order: score (rounded to 9 decimals) desc, then docid asc. Ids are whole numbers
    or strings. With ``group``, columns of both sides, a query is the pair of its group
    and its id: it meets only the rows of its own group (e.g. its language), and the same
    id may stand in several groups; a null group meets nothing.

    ``sizes``: a table with the group columns and at least one row per query, where that
    is cheaper to count than ``queries`` (the texts the queries were encoded from).
    """
    group = _names(group)
    both, qtype, rtype = _both(queries, rows, qkey, rkey, vec, group)
    counted = (sizes if sizes is not None else queries).select(group_key(group).alias("g"))
    scores = tiled_scores(both, counted, k, d, qtype, rtype, bool(group))
    return merged(scores, k, group, group_types(queries, group))


def similarity_matrix(a: DataFrame, b: DataFrame, d: int, akey: str = "qid",
                      bkey: str = "docid", vec: str = "embedding") -> DataFrame:
    """(qid, docid, score): cosine of every pair of a row of ``a`` and a row of ``b``.

    The output has |a| x |b| rows by definition; ``a`` is meant to be a stated set of
    queries. Use ``topk`` for retrieval.
    """
    named = lambda df, key, to: df.select(F.col(key).alias(to), F.col(vec).alias("embedding"))      # noqa: E731
    both, qtype, rtype = _both(named(a, akey, "qid"), named(b, bkey, "docid"), "qid", "docid", "embedding", ())
    counted = a.select(F.lit("").alias("g"))
    # as they are, and normalised behind the shuffle
    return tiled_scores(both.withColumn("v", narrow(F.col("v"))), counted, None, d, qtype, rtype, False,
                        V.l2_normalise_expr(widened("v"))).drop("g")


def similarity_pairwise(pairs: DataFrame, vectors: DataFrame, d: int,
                        a: str = "a", b: str = "b", key: str = "pair_id",
                        vkey: str = "row_id", vec: str = "embedding") -> DataFrame:
    """(pair_id, cosine) of the two vectors of each pair (equi joins, no pairs made)."""
    vn = V.l2_normalise_df(vectors.select(F.col(vkey).alias("_id"), F.col(vec).alias("_v")), "_v", d)
    va = vn.select(F.col("_id").alias(a), F.col("_v").alias("_va"))
    vb = vn.select(F.col("_id").alias(b), F.col("_v").alias("_vb"))
    j = pairs.select(key, a, b).join(va, a).join(vb, b)
    return j.select(key, V.dot_expr("_va", "_vb", d).alias("cosine"))
