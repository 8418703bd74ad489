"""Connected components of an edge table by alternating large and small
stars, with joins and aggregates only.  The smallest neighbours are written
before they are joined back: a join of two plain shuffles is one whose large
partitions Spark can split, so a hub with very many links stays harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "edges-least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "edges-least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest
    node it is connected to, itself included.  Self links and repeated links
    are fine; nodes without links don't appear."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        after = materialize(_small_star(_large_star(edges)), "edges")
        # done when no node has two smaller neighbours, or one that has one itself
        ends = after.select(F.col("a").alias("node"), F.lit(2).alias("weight")).unionByName(after.select(F.col("b").alias("node"), F.lit(0).alias("weight")))
        if ends.groupBy("node").agg(F.sum("weight").alias("up"), F.min("weight").alias("least")).where("up > 2 or (up = 2 and least = 0)").limit(1).count() == 0:
            break
        edges = after
    leaves = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
