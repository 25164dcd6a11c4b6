"""Connected components by alternating stars, in Spark; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b): each node's neighbours are tied to its smallest neighbour or itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = common.stored(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "low")
        out = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = common.stored(edges.groupBy("a").agg(F.min("b").alias("m")), "low")
        near = edges.join(low, "a")
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of integers: node, component (its smallest node). Nodes without an edge to another are absent."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    now, before = common.stored(ends, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
        now = common.stored(_stars(common.stored(_stars(now, True), "edges"), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
