"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: links each neighbour to the smallest node around. edges: u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = both.join(least, "u")
    moved = near.where("v > u" if large else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that is not its component's smallest. edges: (u, v) of long."""
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    mark = None
    for _ in range(max_rounds):
        now = durable(_star(_star(now, True), False))
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.countDistinct("u").alias("d")).first()
        if (row["n"], row["h"]) == mark and row["n"] == row["d"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (row["n"], row["h"])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
