"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours under its least neighbour or itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours, and itself, under the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component_id) for every node that has an edge; component_id is the least node reachable.

    Null ends, loops and repeated edges are ignored. The number of rounds grows with the logarithm
    of the longest path.
    """
    now = edges.where(F.col(a) != F.col(b))
    now = common.cut(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    last = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
        now = common.cut(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component_id"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(roots)
