"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm.common import written


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v): root is the smallest node that it is connected with.

    In each round every node points to its smallest neighbour, pointers are followed one step further, and
    the edges are drawn anew between what they point to. Paths shrink to less than half in a round, so the
    number of rounds grows with the logarithm of the longest path. Tables of each round are written, so
    that a hub's edges can be split between tasks and lost executors cost one round at most.
    """
    edges = written(spark, edges.select("u", "v").filter("u != v").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        near = written(
            spark, both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        )
        far = near.select(F.col("u").alias("to"), F.col("to").alias("further"))
        pointers = written(
            spark, near.join(far, "to").select(F.col("u").alias("node"), F.col("further").alias("root"))
        )
        if labels is None:
            labels = pointers
        else:
            moved = pointers.select(F.col("node").alias("root"), F.col("root").alias("to"))
            labels = written(
                spark, labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            )
        from_u = pointers.select(F.col("node").alias("u"), F.col("root").alias("a"))
        from_v = pointers.select(F.col("node").alias("v"), F.col("root").alias("b"))
        edges = written(
            spark,
            edges.join(from_u, "u")
            .join(from_v, "v")
            .filter("a != b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct(),
        )
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
