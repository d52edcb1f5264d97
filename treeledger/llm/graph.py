"""Distributed union-find: connected components by alternating large and small stars.

Every round is a pair of aggregations and joins over edges, so no vertex's neighbours are ever gathered in one task; the
rounds' edges are cut from their lineage with checkpoint(), in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir


def _hook(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (large) or smaller neighbours of each vertex to the smallest vertex near it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    joined = near.join(least.select("a", F.least("a", "m").alias("m")), "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """vertex and root (the smallest vertex of its component) for every vertex that has an edge; edges: a, b.

    Self edges, repeated edges and either direction are fine; edges with a null are left out; no edges: no rows.
    """
    checkpoint_dir(spark)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        now = _hook(_hook(now, True), False).checkpoint()
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
