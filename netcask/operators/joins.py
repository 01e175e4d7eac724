"""Joins on ranges as joins on keys: both sides are cut in cells, and the condition is checked within a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import whole_div


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, cell: int) -> DataFrame:
    """Each point with each range that holds it, both ends included. ``cell``: about the length of a range; a longer one is put in all its cells."""
    p = points.withColumn("_cell", whole_div(F.col(point), cell))
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(whole_div(F.col(low), cell), whole_div(F.col(high), cell))))
    return p.join(r, "_cell").where(F.col(point).between(F.col(low), F.col(high))).drop("_cell")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, then: str, within: int) -> DataFrame:
    """Pairs that agree in ``keys`` where ``then`` is from ``at`` to ``at + within``."""
    a = left.withColumn("_cell", F.explode(F.array(whole_div(F.col(at), within), whole_div(F.col(at), within) + 1)))
    b = right.withColumn("_cell", whole_div(F.col(then), within))
    return a.join(b, [*keys, "_cell"]).where(F.col(then).between(F.col(at), F.col(at) + within)).drop("_cell")
