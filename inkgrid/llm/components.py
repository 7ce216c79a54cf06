"""Connected components of an edge table, by alternating large-star and small-star steps.

Nothing is collected: the driver sees two numbers a round. Neighbour lists are never gathered; each
step is a minimum by node (partly aggregated before the shuffle) joined back to the edges, so a
node of any degree is a skewed join at most, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node has one parent, and no parent has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.count_if(F.expr("up > 1 OR up + down > 1"))).first()[0]


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """``a, b`` edges of long ids -> ``node, root``: root is the least id of the component. Ids without an edge are absent."""
    current, before = edges.select("a", "b").filter("a <> b"), None
    for _ in range(rounds):
        current = materialize(_small_star(_large_star(current)).distinct(), label)
        if before is not None:
            discard(before)  # the new table is whole in the shared folder: no lineage reaches the old one
        before = current
        if _is_star_forest(current):
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError(f"no star forest after {rounds} rounds")
