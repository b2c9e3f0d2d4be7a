"""Connected components of an edge table by alternating large-star and small-star steps, each a grouped minimum and a join.

The minima are written before they are joined, so that both sides of the join come from an exchange alone and adaptive
execution can split the rows of a hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")), "low")
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    low = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u > v, distinct, a written table) -> (node, root) for every node of an edge; root is the smallest node of its component."""
    now, seen = edges, None
    while True:
        large = scratch.write(_large_star(now, scratch), "large")
        small = scratch.write(_small_star(large, scratch).distinct(), "edges")
        scratch.drop(now, large)
        now = small
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == state:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
