"""Connected components by alternating large-star and small-star, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

#: Nodes with so many edges are hubs: their minima are broadcast instead of shuffled. There are no more of them than edges / HUB_EDGES.
HUB_EDGES = 100_000


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Whether every node is either a centre or points to one centre, and the most edges of a node. One aggregate with map-side combine tells both."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), "v").union(edges.select("v", F.lit(0), F.lit(None).cast("long")))
    seen = ends.groupBy("x").agg(F.max("leaf").alias("leaf"), F.min("leaf").alias("only"), F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n"))
    odd, most = seen.agg(F.max((F.col("leaf") != F.col("only")) | F.coalesce(F.col("a") != F.col("b"), F.lit(False))), F.max("n")).first()
    return not odd, most or 0


def _beside(edges: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """(u, v, m): edges with their node's minimum; least: u, m, n, its edges. No hub's edges are a group of one task."""
    if not hubs:
        return edges.join(least.select("u", "m"), "u").select("u", "v", "m")
    many = F.col("n") >= HUB_EDGES
    told = F.broadcast(least.where(many).select("u", "m"))
    others = edges.join(F.broadcast(least.where(many).select("u")), "u", "left_anti").join(least.where(~many).select("u", "m"), "u")
    return edges.join(told, "u").select("u", "v", "m").union(others.select("u", "v", "m"))


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Each node, and its neighbours that are not larger, point to the smallest of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _beside(edges, least, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """The larger neighbours of each node point to the smallest node of its neighbourhood, itself included."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _beside(both, least, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for each node of edges (u, v): label is the smallest node that it reaches. Loops and repeats do no harm.

    Minima are taken with map-side combine and joined back, or broadcast for hubs, so a node with very many neighbours is no group of one task.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        stars, most = _state(edges)
        if stars:
            break
        hubs, done = most >= HUB_EDGES, edges
        edges = settle(_small_star(_large_star(edges, hubs), hubs))
        discard(done)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
