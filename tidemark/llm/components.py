"""Connected components by alternating star contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds needed grow with the logarithm of the longest chain; running out of them is an error, never a wrong answer.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def connected(edges: DataFrame) -> DataFrame:
    """edges: u, v (any orderable type, u > v). Returns node, root for every node but the roots themselves.

    Neighbours of a node are never gathered: each step takes a grouped minimum, which is combined before the shuffle,
    and joins it back to the edge rows, whose partitions adaptive execution splits when a node is hot.
    """
    edges = cut(edges.select("u", "v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now.n == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        large = _large_star(edges).distinct()
        edges = cut(_small_star(large).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
