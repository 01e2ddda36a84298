"""Connected components of a graph given as a table of edges, by alternating stars: every round is two aggregations and joins, no group is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle


def _smallest(edges: DataFrame) -> DataFrame:
    """u, v, m: the edges with the smallest of u and its neighbours. The minima are a table of their own, so the join can be split at a hub."""
    least = settle(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return edges.join(least, "u")


def _stars(links: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none."""
    sides = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """edges (a, b) -> node, component: every node that an edge names, with the smallest node reachable from it.

    Larger neighbours are hung on the smallest one of a node, then smaller ones and the node itself, until all that is left are stars: the number of
    rounds grows with the logarithm of a component's length, and there is none where the edges are stars from the start. Nulls name no node; loops
    and repeated edges are fine; no edges give no rows.
    """
    plain = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = plain.select(F.col("u").alias("node")).unionByName(plain.select(F.col("v").alias("node"))).distinct()
    links = settle(plain.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = settle(_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        near = _smallest(links)  # here v < u throughout
        links = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
