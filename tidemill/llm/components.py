"""Connected components by alternating large and small stars.

Every round hangs the neighbours of a vertex on the smallest label among them, until each component is one star around its
smallest vertex. Minima are taken by grouped aggregation, which combines within tasks, and are joined back, so a vertex with
very many links is split like any other skewed join key. Each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every vertex of the links (u, v), the smallest vertex of its component. Loops and repeats are fine."""
    spark = edges.sparkSession
    now, path = stash(edges.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        large, large_path = stash(_large(now), "large-star")
        after, new = stash(_small(large), "small-star")
        discard(spark, path)
        discard(spark, large_path)
        now, path = after, new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
