"""Connected components of a table of links, by alternating large-star and small-star steps.

Each round is two joins on pre-aggregated minima; links are written to the shared folder after each, so lineage stays
short. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import dealt, discard, written


def splittable(sums: DataFrame, key: str) -> DataFrame:
    """Sums by a long ``key``, to be joined to their rows. A sum stays where its key was gathered, and a join there could not
    be split; as the key is computed anew, the join deals both sides itself, and AQE can divide the rows of a hot key.
    (The optimizer sees through ``key + 0``, not through two negations.)"""
    return sums.select(F.bitwise_not(F.bitwise_not(F.col(key))).alias(key), *(c for c in sums.columns if c != key))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: every node links its larger (large) or smaller (small) neighbours to the least node it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where(F.col("b") < F.col("a"))
    least = side.groupBy("a").agg(F.min("b").alias("m"))
    least = splittable(least.select("a", F.least("a", "m").alias("m")), "a")
    moved = side.join(dealt(least), "a").where(F.col("b") > F.col("a") if large else F.lit(True)).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)`` that isn't its own root; ``root`` is its component's least node.

    Links may repeat, come in either direction, or join a node to itself (which says nothing). Nodes are longs.
    """
    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = written(ordered, "links")
    state = None
    while True:
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now["n"]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        large = written(_star(current, True), "links")
        small = written(_star(large, False), "links")
        discard(current, large)
        current = small
