"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to the least neighbour, first for larger and
then for smaller neighbours; every node ends in a star around the least node of
its component. Rounds are written to the shared folder. Nothing but whether every
node hangs on one root reaches the driver in a round, and a node with many links is met by a join with
its pre-aggregated minimum, which AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").filter("b > a")
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node that is not a root hangs on one root."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = links.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter(
        "up > 1 or up = 1 and down = 1").isEmpty()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component_id) after more links: ``labels``, as ``components`` gives them, and ``links`` (a, b).

    Only the graph of the components that the links join is worked on; all other labels stay.
    """
    node = lambda c: F.coalesce(F.col(f"l_{c}"), F.col(c))      # noqa: E731
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component_id").alias(f"l_{c}"))
    links = links.select("a", "b").filter("a <> b")
    between = cut_lineage(links.join(of("a"), "a", "left").join(of("b"), "b", "left")
                          .select("a", "b", node("a").alias("x"), node("b").alias("y")), "contracted")
    moved = components(between, "x", "y").select(F.col("node").alias("component_id"), F.col("component_id").alias("to"))
    ends = between.select(F.col("a").alias("node"), F.col("x").alias("component_id")).union(between.select("b", "y"))
    return (labels.union(ends).distinct().join(moved, "component_id", "left")
            .select("node", F.coalesce("to", "component_id").alias("component_id")))


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component_id) for every node that has a link; the least node names it.

    Links may repeat, run either way or join a node to itself (ignored); null
    ends are ignored. Raises if the stars have not settled after ``rounds``
    (the count grows with the logarithm of the longest chain).
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    links = cut_lineage(_small_star(links), "stars")
    for _ in range(rounds):
        if _settled(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(
                links.select("b", "b").distinct())
        links = cut_lineage(_small_star(_large_star(links)), "stars")
    raise RuntimeError(f"links did not settle in {rounds} rounds")
