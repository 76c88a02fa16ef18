"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, remove


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang the neighbours above a node (large) or below it (small) on the least of them all.

    The least is found by a pre-aggregated minimum and joined back as a unique
    side, so a node with very many neighbours can be split.
    """
    both = edges if not large else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.join(least, "u")
    if large:
        return hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str, name: str = "components", most: int = 60) -> DataFrame:
    """node, root for every node of ``links``: root is the least node it can reach. Nodes are longs."""
    spark = links.sparkSession
    ordered = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(ordered(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), name, links.count())
    state, n = None, edges.count()  # a step makes no more edges than it had, and one for each node
    for _ in range(most):
        new = cut(ordered(_star(ordered(_star(edges, True)), False)), name, 2 * n)
        remove(spark, edges)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
