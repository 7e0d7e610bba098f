"""Connected components of an edge table by alternating large and small stars; no edge leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagwise.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to its smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.withColumnRenamed("m", "b")).where("a > b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` (longs, a > b): root is the component's least node.

    Nodes that are their own root are left out. An empty table of edges gives an empty result.
    """
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = stored(edges.distinct())
    seen = state(now)
    while True:
        now = stored(_small_star(_large_star(now).distinct()).distinct())
        before, seen = seen, state(now)
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
