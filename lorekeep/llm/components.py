"""Connected components of a link table by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (a, b), longs. (node, component) of every node that has a link; component is the least node of its component.

    A star step gives each node's neighbours to the least of them. Rounds grow with the logarithm of the longest chain.
    Joins and groupings are by node. Minima are written before they are joined, so both sides of a join are plain
    exchanges and adaptive execution can split a node of very many neighbours; aggregation keeps one minimum a node. Tables
    of rounds that are over go. An error is raised if it hasn't settled after max_rounds.
    """
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    was = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        discard(least, edges)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small, "stars")
        discard(least, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components haven't settled")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component")).groupBy("node").agg(F.min("component").alias("component"))
