"""Connected components by alternating star contraction.

Every round is two joins and two aggregations over the remaining edges, which
only shrink towards stars; the edges of a round are written to the shared
folder, so neither lineage nor the driver's memory grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component`` (least node of its component) for every node that has an edge to another.

    Edges are undirected; null ends and loops say nothing.  Rounds go on until one changes nothing: each lowers the
    node that some edge points to or leaves stars, so they end, after some logarithm squared of the number of nodes.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    state = None
    while True:
        now = written(_small_star(_large_star(now)))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
