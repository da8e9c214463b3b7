"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and no node with an edge down has one from above: nothing is left to do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 0 and down + up > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v bigint) to (node, root): root is the smallest node of its component; roots themselves have no row."""
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        step = _small_star(_large_star(now)).where("u <> v").distinct()
        new = scratch.save(step, "edges")
        scratch.drop(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
