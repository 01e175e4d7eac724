"""Steps that choose packets. Each returns its outputs by link name; a link that nobody reads costs nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draw import draw
from ..plans.filterlang import predicate, split
from ..plans.ranges import in_ranges, time_bounds
from ..plans.streamspec import stream_predicate
from ..schema import FLAG_NAMES, whole_div
from .order import first_value, with_position, with_running_max

Links = dict[str, DataFrame]


def packet_filter(df: DataFrame, bpf: str | None = None, where: Column | None = None) -> Links:
    if (bpf is None) == (where is None):
        raise ValueError("exactly one of bpf and where")
    if bpf is not None:
        return split(df, bpf)
    p = F.coalesce(where, F.lit(False))
    return {"": df.where(p), "not_matched": df.where(~p)}


def stream_filter(df: DataFrame, spec: str) -> DataFrame:
    return df.where(stream_predicate(spec))


def _positioned(df: DataFrame, dense: bool, position: str) -> tuple[DataFrame, bool]:
    """The source's index serves if it has no gaps; else positions are counted."""
    return (df.withColumn(position, F.col("pkt_idx")), True) if dense else (with_position(df, position), False)


def range_filter(df: DataFrame, ranges: str, dense: bool = False) -> Links:
    d, _ = _positioned(df, dense, "_pos")
    p = in_ranges(F.col("_pos"), ranges)
    return {"": d.where(p).drop("_pos"), "reject": d.where(~p).drop("_pos")}


def pass_n(df: DataFrame, n: int, dense: bool = False) -> Links:
    d, _ = _positioned(df, dense, "_pos")
    return {"": d.where(F.col("_pos") < n).drop("_pos"), "the_rest": d.where(F.col("_pos") >= n).drop("_pos")}


def drop_every(df: DataFrame, n: int, dense: bool = False) -> Links:
    d, _ = _positioned(df, dense, "_pos")
    nth = F.col("_pos") % n == n - 1
    return {"": d.where(~nth).drop("_pos"), "drop": d.where(nth).drop("_pos")}


def time_filter(df: DataFrame, time_range: str, out_of_order: bool = False) -> Links:
    """Inclusive bounds. Unless ``out_of_order``, what follows the first packet beyond the end is rejected for good."""
    d = df.crossJoin(F.broadcast(first_value(df, "ts_ns")))  # one row
    low, high = time_bounds(time_range, F.col("first"))
    p = F.lit(True)
    if low is not None:
        p = p & (F.col("ts_ns") >= low)
    if high is not None:
        p = p & (F.col("ts_ns") <= high)
        if not out_of_order:
            d = with_running_max(d, F.when(F.col("ts_ns") > high, 1).otherwise(0), "_over")
            p = p & (F.col("_over") == 0)
    extra = [c for c in ("first", "_over") if c in d.columns]
    return {"": d.where(p).drop(*extra), "reject": d.where(~p).drop(*extra)}


def discard(df: DataFrame, kinds: list[str] | int) -> DataFrame:
    mask = kinds if isinstance(kinds, int) else sum({FLAG_NAMES[k.lower()] for k in kinds})
    return df.where(F.col("flags").bitwiseAND(mask) == 0)


def drop_at_random(df: DataFrame, share: float, seed: int) -> Links:
    """Decided by a hash of the index and the seed, so that a rerun decides alike."""
    gone = draw(F.col("pkt_idx"), seed) < int(share * (1 << 32))
    return {"": df.where(~gone), "drop": df.where(gone)}


def until(df: DataFrame, where: Column) -> DataFrame:
    """All packets up to and with the first for which ``where`` holds; all, if it holds for none."""
    first = df.where(where).agg(F.min("pkt_idx").alias("_last"))
    return df.crossJoin(F.broadcast(first)).where(F.col("_last").isNull() | (F.col("pkt_idx") <= F.col("_last"))).drop("_last")  # one row


def every_other(df: DataFrame, by: str = "src", second_ns: int = 1_000_000_000) -> Links:
    """``tap``: of each second since the capture's first packet every other packet, from the second one on. ``""`` has all, with ``in_second``, the packet's number in its second."""
    first = df.groupBy(by).agg(F.min_by("ts_ns", "pkt_idx").alias("_first"))  # a row a capture
    d = df.join(first, by).withColumn("_second", whole_div(F.col("ts_ns") - F.col("_first"), second_ns))
    d = d.withColumn("in_second", F.row_number().over(Window.partitionBy(by, "_second").orderBy("pkt_idx")).cast("long")).drop("_first", "_second")
    return {"": d, "tap": d.where(F.col("in_second") % 2 == 0)}


def tap(df: DataFrame, bpf: str | None = None, snap: int | None = None, keep_flags: bool = False) -> Links:
    """All packets go on; copies, filtered and cut, go to ``tap``. Copies carry no flags unless asked."""
    copy = df.where(predicate(bpf)) if bpf else df
    if snap is not None:
        copy = copy.withColumn("data", F.substring("data", 1, snap))
    if not keep_flags:
        copy = copy.withColumn("flags", F.lit(0))
    return {"": df, "tap": copy}


def demux(df: DataFrame, filters: dict[str, str], rest: str = "unmatched") -> DataFrame:
    """Add ``link``: the first filter that matches, else ``rest``."""
    out = None
    for name, bpf in filters.items():
        p = predicate(bpf)
        out = F.when(p, name) if out is None else out.when(p, name)
    return df.withColumn("link", F.lit(rest) if out is None else out.otherwise(rest))


def stopcock(df: DataFrame, commands: DataFrame, start: int = 0) -> DataFrame:
    """Add ``hop``: the value of the last command (ts_ns, hop) at or before the packet. An as-of join by union and a running last value, in time buckets."""
    from pyspark.sql import Window

    from ..schema import whole_div

    width = 60_000_000_000
    c = commands.select("ts_ns", "hop").withColumn("_bucket", whole_div(F.col("ts_ns"), width))
    ends = c.groupBy("_bucket").agg(F.max_by("hop", "ts_ns").alias("hop"))
    b = df.withColumn("_bucket", whole_div(F.col("ts_ns"), width))
    all_buckets = ends.unionByName(b.select("_bucket").distinct().withColumn("hop", F.lit(None).cast("int"))).groupBy("_bucket").agg(F.first("hop", ignorenulls=True).alias("hop"))
    before = all_buckets.select("_bucket", F.last("hop", ignorenulls=True).over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    both = b.withColumn("_hop", F.lit(None).cast("int")).withColumn("_p", F.lit(1)).unionByName(
        c.select("_bucket", "ts_ns", F.col("hop").alias("_hop"), F.lit(0).alias("_p")), allowMissingColumns=True
    )
    w = Window.partitionBy("_bucket").orderBy("ts_ns", "_p").rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumn("_last", F.last("_hop", ignorenulls=True).over(w)).where("_p = 1").join(before, "_bucket", "left")
    return done.withColumn("hop", F.coalesce("_last", "_before", F.lit(start))).drop("_bucket", "_hop", "_p", "_last", "_before")
