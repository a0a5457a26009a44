"""Connected components by alternating large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: then every v is the least of its component."""
    per = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    inner = edges.select(F.col("v").alias("u")).distinct().join(per, "u", "left_semi")
    return per.where("c > 1").select("u").union(inner).isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """links (a, b: long) to one row (k, root) for each linked k, root being the smallest k reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        # tables of their own, so that the joins may split a hub
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct(), "large-star")
        dropped(least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = written(small.where("u > v").distinct(), "small-star")
        dropped(edges, large, least)
        edges = after
    return edges.select(F.col("u").alias("k"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
