"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step hangs nodes under the smallest neighbour seen. A step reads a written table and writes the next, so
a lost executor costs at most one step. Minima are aggregated with a combine before the shuffle and written, so the
join back has plain exchanges on both sides, which adaptive execution splits where a hub has many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has longs u, v. Returns (node, root) for every node of an edge; root is the smallest node of its component."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "cc-edges")
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = materialize(_pairs(both.join(low, "u").where("v > u"), "v", "m"), "cc-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(_pairs(moved, "u", "v"), "cc-small")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
