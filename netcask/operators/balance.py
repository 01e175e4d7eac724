"""Steps with several inputs or outputs: union, merge, round robin, flow-affine balancing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import whole_div
from .order import with_last_known, with_position

#: Packets of a flow further apart than this start a new flow.
FLOW_IDLE_NS = 5_000_000_000


def union(*inputs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def merge(*inputs: DataFrame) -> DataFrame:
    """All inputs in order of time; equal times: by input, then index. Adds ``src`` where an input has none. A range-partitioned sort."""
    named = [d if "src" in d.columns else d.withColumn("src", F.lit(i).cast("long")) for i, d in enumerate(inputs)]
    return union(*named).orderBy("ts_ns", "src", "pkt_idx")


def spread(df: DataFrame, n: int, dense: bool = False) -> DataFrame:
    """Add ``output``: packets dealt to n outputs in turn."""
    d = df.withColumn("_pos", F.col("pkt_idx")) if dense else with_position(df, "_pos")
    return d.withColumn("output", (F.col("_pos") % n).cast("long")).drop("_pos")


def gather(df: DataFrame, n: int, input_col: str = "output") -> DataFrame:
    """One from each input in turn, until an input has none. ``df`` holds all inputs; each must be in order of pkt_idx. Adds ``seq``.

    Positions in an input are counted in buckets (as in ``order``)."""
    from ..schema import whole_div
    from .order import WIDTH

    b = df.withColumn("_bucket", whole_div(F.col("pkt_idx"), WIDTH))
    w = Window.partitionBy(input_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = b.groupBy(input_col, "_bucket").agg(F.count("*").alias("_n")).select(input_col, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(input_col, "_bucket").orderBy("pkt_idx")
    d = b.join(before, [input_col, "_bucket"]).withColumn("seq", (F.col("_before") + F.row_number().over(inside) - 1) * n + F.col(input_col))
    sizes = df.groupBy(input_col).agg(F.count("*").alias("_n"))
    have = sizes.agg(F.collect_list(F.struct(F.col(input_col).alias("i"), F.col("_n").alias("c"))).alias("_have"))  # n entries
    stop = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(F.transform(F.filter("_have", lambda h: h.i == i), lambda h: h.c), 1), F.lit(0)) * n + i))
    return d.crossJoin(F.broadcast(have)).where(F.col("seq") < stop).drop("_bucket", "_before", "_have")


def flow_key() -> dict[str, Column]:
    """Both directions of a flow have the same key. Only IPv4 has addresses in it, and only TCP has ports."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    is_ip = src.isNotNull()
    tcp = is_ip & (F.col("ip_proto") == 6) & F.col("sport").isNotNull()
    up = src < dst
    zero = F.lit(0).cast("long")
    return {
        "ip_a": F.when(is_ip, F.greatest(src, dst)).otherwise(zero),
        "ip_b": F.when(is_ip, F.least(src, dst)).otherwise(zero),
        "port_a": F.when(tcp, F.when(up, F.col("dport")).otherwise(F.col("sport"))).otherwise(zero),
        "port_b": F.when(tcp, F.when(up, F.col("sport")).otherwise(F.col("dport"))).otherwise(zero),
        "flow_vlan": F.coalesce(F.col("vlan_id"), F.lit(-1)).cast("long"),
        "flow_proto": F.when(is_ip & (F.col("ip_proto") == 6), F.lit("tcp")).otherwise(F.lit("other")),
    }


KEY = ["ip_a", "ip_b", "port_a", "port_b", "flow_vlan", "flow_proto"]


def with_flow_key(df: DataFrame) -> DataFrame:
    return df.withColumns(flow_key())


def flows(df: DataFrame) -> DataFrame:
    """A row for each flow: packets, bytes, first and last packet, work (300 and the captured bytes for each packet)."""
    return (
        with_flow_key(df)
        .groupBy(*KEY)
        .agg(
            F.count("*").alias("pkts"),
            F.sum("frame_len").alias("link_bytes"),
            F.sum("cap_len").alias("cap_bytes"),
            F.min("pkt_idx").alias("first_idx"),
            F.min("ts_ns").alias("first_ns"),
            F.max("ts_ns").alias("last_ns"),
            F.sum(300 + F.col("cap_len")).alias("work"),
        )
    )


def with_sessions(df: DataFrame, idle_ns: int | None = FLOW_IDLE_NS) -> DataFrame:
    """Add the flow key and ``start_idx``, the first packet of the flow or, where packets of it are ``idle_ns`` or more apart, of the part since. In buckets, so that no
    task sees all of a flow."""
    d = with_flow_key(df).withColumn("_flow", F.struct(*KEY))
    if idle_ns is None:
        return d.join(d.groupBy("_flow").agg(F.min("pkt_idx").alias("start_idx")), "_flow").drop("_flow")
    d = with_last_known(d, F.col("ts_ns"), "_prev", "_flow")
    new = F.col("_prev").isNull() | (F.col("ts_ns") - F.col("_prev") >= idle_ns)
    d = with_last_known(d.withColumn("_new", F.when(new, F.col("pkt_idx"))), F.col("_new"), "_from", "_flow")
    return d.withColumn("start_idx", F.coalesce("_new", "_from")).drop("_flow", "_prev", "_new", "_from")


def balance_round_robin(df: DataFrame, n: int, idle_ns: int | None = None) -> DataFrame:
    """Add ``output``: flows go to outputs in turn, by their first packet; after ``idle_ns`` without a packet a flow is a new one. The turn is counted over first
    packets only, in buckets."""
    d = with_sessions(df, idle_ns)
    seen = with_position(d.select(F.col("start_idx").alias("pkt_idx")).distinct(), "_turn")
    return d.join(seen.select(F.col("pkt_idx").alias("start_idx"), (F.col("_turn") % n).alias("output")), "start_idx").drop(*KEY, "start_idx")


def flow_sessions(df: DataFrame, idle_ns: int = FLOW_IDLE_NS) -> DataFrame:
    """Flows cut where a packet comes ``idle_ns`` or more after the one before: (key, session, pkts, first_ns, last_ns)."""
    parts = with_sessions(df, idle_ns).groupBy(*KEY, "start_idx").agg(F.count("*").alias("pkts"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("start_idx")) - 1  # a row a part
    return parts.withColumn("session", number.cast("long")).drop("start_idx")


def balance_least_load(df: DataFrame, n: int, idle_ns: int | None = None) -> DataFrame:
    """Add ``output``: a new flow goes to the output with the least work so far (ties: the first), decided from the flows' totals in order of their first packets;
    after ``idle_ns`` without a packet a flow is a new one.

    The decision for a flow depends on all before it, so this is a fold in order over the flow rows, in one task that holds n sums; packets aren't in it."""
    d = with_sessions(df, idle_ns)
    f = d.groupBy("start_idx").agg(F.sum(300 + F.col("cap_len")).alias("work"))
    schema = "start_idx long, output long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(0, i) for i in range(n)]  # a heap
        for b in batches:
            outputs = []
            for work in b.column("work").to_pylist():
                load, i = loads[0]
                heapq.heapreplace(loads, (load + (work or 0), i))
                outputs.append(i)
            yield pa.RecordBatch.from_arrays([b.column("start_idx"), pa.array(outputs, pa.int64())], names=["start_idx", "output"])

    dealt = f.repartition(1).sortWithinPartitions("start_idx").mapInArrow(deal, schema)
    return d.join(dealt, "start_idx").drop(*KEY, "start_idx")


def load_averages(df: DataFrame, period_ns: int = 100_000_000, short: float = 0.1, long: float = 0.01, output_col: str = "output") -> DataFrame:
    """(output, period, work, load_est_short, load_est_long) for periods that have packets: moving averages of an output's work (300 and the captured bytes for each packet) as
    whole numbers, with weights in 65536ths. Between two such periods the averages decay by the empty ones. A fold over an output's period rows."""
    weights = [int(short * 65536), int(long * 65536)]

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("period")
        last, est, out = None, [0, 0], []
        for period, work in zip(t.column("period").to_pylist(), t.column("work").to_pylist(), strict=True):
            for _ in range(0 if last is None else period - last - 1):
                new = [e - (w * e >> 16) for e, w in zip(est, weights, strict=True)]
                if new == est:
                    break
                est = new
            est = [(w * work >> 16) + ((65536 - w) * e >> 16) for e, w in zip(est, weights, strict=True)]
            last = period
            out.append((period, work, *est))
        cols = list(zip(*out, strict=True))
        return pa.table({output_col: pa.array([key[0].as_py()] * len(out), pa.int64()), **{k: pa.array(c, pa.int64()) for k, c in zip(("period", "work", "load_est_short", "load_est_long"), cols, strict=True)}})

    b = df.groupBy(F.col(output_col).cast("long").alias(output_col), whole_div(F.col("ts_ns"), period_ns).alias("period")).agg(F.sum(300 + F.col("cap_len")).alias("work"))
    return b.groupBy(output_col).applyInArrow(fold, f"`{output_col}` long, period long, work long, load_est_short long, load_est_long long")


def rings(df: DataFrame, n: int) -> DataFrame:
    """Add ``ring``: the bytes of both addresses folded by exclusive or, for untagged IPv4; else 0."""
    v = F.col("src_ip").bitwiseXOR(F.col("dst_ip"))
    folded = v
    for s in (8, 16, 24):
        folded = folded.bitwiseXOR(F.call_function("shiftright", v, F.lit(s)))
    return df.withColumn("ring", F.when(F.col("src_ip").isNotNull() & F.col("vlan_id").isNull(), folded.bitwiseAND(255) % n).otherwise(0).cast("long"))
