"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged as stage


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Neighbours of a node are linked to the smallest of them and it: the larger
    neighbours (large star), or the smaller ones and the node itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(stage(least, "star-least"), "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b < a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter("a != b").distinct()


def settled(edges: DataFrame) -> bool:
    """Every node is linked once, and to a node that is not linked any further."""
    roots = edges.select(F.col("b").alias("a"), F.lit(2).alias("n"))
    twice = edges.select("a", F.lit(1).alias("n")).unionByName(roots.distinct()).groupBy("a").agg(
        F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    return twice.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every node of the links a, b."""
    edges = stage(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "star-links")
    while not settled(edges):
        edges = stage(star(stage(star(edges, True), "star-large"), False), "star-small")
    return stage(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "star-labels")
