"""Which file a packet goes to: rotation by time and by size, and file names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import whole_div
from .order import added, fold

NS = 1_000_000_000
# The divisors, in seconds, to which the first file's time is rounded down.
BOUNDARIES = [5, 10, 15, 20, 30, 60, 120, 300, 600, 900, 1200, 1800, 2400, 2700, 3600, 7200, 14400, 21600, 28800, 43200, 86400]


def boundary(rotate_seconds: int) -> int:
    return max([1, *(b for b in BOUNDARIES if rotate_seconds % b == 0)])


def rotate_by_time(df: DataFrame, rotate_seconds: int) -> DataFrame:
    """Add ``file_start`` (seconds): files are ``rotate_seconds`` long, from the first packet's time rounded down."""
    first = df.agg(F.min_by("ts_ns", "pkt_idx").alias("_first"))
    unit = boundary(rotate_seconds)
    d = df.crossJoin(F.broadcast(first))  # one row
    origin = whole_div(F.col("_first"), NS * unit) * unit
    turn = whole_div(F.greatest(F.col("ts_ns") - origin * NS, F.lit(0)), NS * rotate_seconds)
    return d.withColumn("file_start", origin + turn * rotate_seconds).drop("_first")


def rotate_by_size(df: DataFrame, limit: int, snap: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Add ``file_index``. A file is closed before the packet that would come when it already holds ``limit`` bytes or more: 24 for its header, 16 and
    the captured bytes for each packet. Where a file ends depends on where it began, so this is a fold in order within each group of ``by``
    (``src`` unless given)."""
    by = by or ["src"]

    def cut(state: tuple[int, int], rows: pa.Table) -> tuple[tuple[int, int], pa.Table]:
        index, held = state
        sizes = pc.fill_null(rows.column("cap_len"), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(16 + (sizes if snap is None else np.minimum(sizes, snap)))
        out, at, before = np.empty(len(ends), np.int32), 0, 0
        while at < len(ends):
            if held >= limit:
                index, held = index + 1, 24
            last = max(at, int(np.searchsorted(ends, limit - held + before)))  # the packet with which the file is full
            end = min(last + 1, len(ends))
            out[at:end] = index
            held, before, at = held + int(ends[end - 1]) - before, int(ends[end - 1]), end
        return (index, held), added(rows, "file_index", pa.array(out))

    return fold(df, by, ["cap_len"], (0, 24), cut, df.select("*", F.lit(0).alias("file_index")).schema)


def file_name(template: str, index: Column, start_seconds: Column, pad: int = 0) -> Column:
    """``$i`` becomes the index, padded; without it the index is appended. Then %Y %m %d %H %M %S in UTC."""
    number = F.lpad(index.cast("string"), pad, "0") if pad else index.cast("string")
    parts = template.split("$i")
    text: Column = F.concat(*[x for i, p in enumerate(parts) for x in ([number] if i else []) + [F.lit(p)]]) if len(parts) > 1 else F.concat(F.lit(template), number)
    when = F.timestamp_seconds(start_seconds)
    for code, pattern in {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}.items():
        if code in template:
            text = F.replace(text, F.lit(code), F.date_format(when, pattern))
    return text
