"""Connected components of an edge table by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v): every v is linked to the smallest neighbour of u instead of to u."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least.withColumn("least", F.least("u", "least")), "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the smallest node it reaches.

    Every round costs two aggregations and two joins on the edges that are left, and rounds grow with the
    logarithm of the longest path. Self-links are ignored; an empty table has no nodes.
    """
    now = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = _star(large)
        kept = small.select("u", F.col("least").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("least").alias("v")))
        now = durable(kept.filter("u <> v").distinct(), "edges")
    raise RuntimeError(f"components still change after {most_rounds} rounds")
