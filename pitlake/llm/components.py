"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ws.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ws.save(down.groupBy("u").agg(F.min("v").alias("m")))
    spread = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return spread.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component): the smallest id reachable, for every node of an edge table (u, v).

    Self-loops are ignored. Each round is a written table; rounds are about the logarithm of the
    longest chain. Minima are taken before the shuffle and written, so both sides of a star's join are
    plain shuffles, and adaptive execution splits that of a hot centre.
    """
    now = ws.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        large = ws.save(_large_star(now, ws))
        nxt = ws.save(_small_star(large, ws))
        ws.drop(now, large)
        now = nxt
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(seen)
