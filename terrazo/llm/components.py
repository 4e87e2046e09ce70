"""Connected components of an edge table by large-star and small-star steps, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """edges: a, b (long). Gives node, component (the smallest node reachable) for each node of an edge.

    Each round writes its edges to the shared folder, so a lost executor costs one round.
    """
    both = F.when(F.col("a") > F.col("b"), F.struct(F.col("a").alias("a"), F.col("b").alias("b"))).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    now = scratch.cut(edges.where("a <> b").select(both.alias("e")).select("e.a", "e.b").distinct(), f"{tag}0")
    for i in range(1, 200):
        # Large star: each neighbour above a node is linked to the node's smallest neighbour.
        out = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = out.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = out.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its lower neighbours are linked to the lowest.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = scratch.cut(small, f"{tag}{i}")
        changed = _differs(now, new)
        scratch.drop(f"{tag}{i - 1}")
        now = new
        if not changed:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _differs(x: DataFrame, y: DataFrame) -> bool:
    def of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())

    return of(x) != of(y)
