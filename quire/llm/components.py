"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and a join on node ids whose aggregated side has one row a node, so a hub
never meets in one task as a list: its rows are split by the skew handling of the join, which needs that
side to be a table of its own. The number of steps grows with the logarithm of the longest path; each
step's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is linked to the least of that node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars-least")
    return both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour not greater than a node, and the node, are linked to the least of them. Edges have a < b."""
    least = written(edges.groupBy("b").agg(F.min("a").alias("m")), "stars-least")
    rest = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return rest.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node in links a, b (longs). Order and repetition of links
    do not matter; loops are ignored; without links the result is empty."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "stars")
    state = None
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        # Stars do not change any more once a pass keeps the number of edges and the sum over their hashes.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
