"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins; nothing but a count and a checksum of the
edges reaches the driver. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written_at


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    joined = both.join(low, "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    sides = down.join(low, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return sides.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)``: root is the smallest node reachable.

    Self-loops and rows with a null are ignored, repeated edges are harmless, an empty table
    gives an empty result. Nodes without an edge do not occur. Raises if ``max_rounds`` do
    not suffice (it would need more than 2^60 nodes).
    """
    now, path = written_at(
        edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        before, last = mark, path
        now, path = written_at(_small_star(_large_star(now)), "edges")
        remove(now.sparkSession, last)
    raise RuntimeError("components did not settle")
