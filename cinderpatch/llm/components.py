"""Connected components by alternating large and small stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each node ``u`` the least of itself and its neighbours; a hot node is pre-aggregated before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and sum of hashes: tells whether a round changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least id that each node of an edge reaches. Loops and nulls are ignored.

    Each round points every larger neighbour of a node at the node's least neighbour (large star), then
    every node's smaller neighbours at the least of them (small star), until all edges point at a
    component's least node. No neighbour list is gathered; rounds grow with the logarithm of the size.
    The least neighbours are written before the join, so that Spark can split the edges of a hub.
    """
    now = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    before = _mark(now)
    while before[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(saved(_nearest(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct())
        small = large.join(saved(_nearest(large)), "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = saved(small)
        mark = _mark(now)
        if before == mark:
            break
        before = mark
    tips = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tips.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component")
    )
