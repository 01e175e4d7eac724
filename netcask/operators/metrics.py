"""Rates, counters and checks over packets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CRC_ERROR, CSUM_ERROR, MCAST_MISMATCH, TRUNCATED, UCAST_MISMATCH, whole_div
from .order import with_previous


def raw_rates(df: DataFrame, period_ns: int = 100_000_000) -> DataFrame:
    """Packets and bytes by period, for periods that have any: one aggregate with a combine before its shuffle."""
    b = df.withColumn("period", whole_div(F.col("ts_ns"), period_ns))
    return b.groupBy("period").agg(F.count("*").alias("pkts"), F.sum("cap_len").alias("cap_bytes"), F.sum("frame_len").alias("link_bytes"))


def smoothed_rates(df: DataFrame, period_ns: int = 100_000_000, alpha: float = 0.5) -> DataFrame:
    """Exponential moving averages, from zero; empty periods count as zero samples.

    Between two periods with packets the average only decays, so gaps aren't filled in. Averages are folded in order of periods, in buckets of them;
    each bucket starts with the periods before it that reach into it: what is older weighs less than a double can show, whatever ``alpha`` is."""
    reach = max(60, math.ceil(math.log(2**-53) / math.log1p(-alpha))) if alpha < 1 else 60
    width = max(100_000, reach)
    rates = raw_rates(df, period_ns)
    b = rates.withColumn("_bucket", whole_div(F.col("period"), width)).withColumn("_copy", F.lit(0))
    spill = b.where(F.pmod(F.col("period"), F.lit(width)) >= width - reach).withColumns({"_bucket": F.col("_bucket") + 1, "_copy": F.lit(1)})
    scales = (1e9 / period_ns, 8e9 / period_ns, 8e9 / period_ns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, state = None, 0, [0.0] * 3
        for rows in batches:
            out: list[tuple] = []
            for bucket, period, copy, *sums in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if bucket != at:
                    at, last, state = bucket, period, [0.0] * 3
                decay = (1 - alpha) ** (period - last)
                state = [x * decay + alpha * v for x, v in zip(state, sums, strict=True)]
                last = period
                if not copy:
                    out.append((period, *(x * k for x, k in zip(state, scales, strict=True))))
            cols = [*zip(*out, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), *[pa.float64()] * 3], strict=True)], names=["period", "pkt_rate", "cap_bw", "link_bw"])

    both = b.unionByName(spill).select("_bucket", "period", "_copy", "pkts", "cap_bytes", "link_bytes")
    return both.repartition("_bucket").sortWithinPartitions("_bucket", "period").mapInArrow(fold, "period long, pkt_rate double, cap_bw double, link_bw double")


def error_counters(df: DataFrame, by: str = "src") -> DataFrame:
    def bad(bit: int):
        return F.count_if(F.col("flags").bitwiseAND(bit) != 0)

    return df.groupBy(by).agg(
        F.count("*").alias("n_rx_pkts"),
        F.sum("frame_len").alias("n_rx_bytes"),
        bad(CSUM_ERROR).alias("n_rx_csum_bad"),
        bad(CRC_ERROR).alias("n_rx_crc_bad"),
        bad(TRUNCATED).alias("n_rx_trunc"),
        bad(MCAST_MISMATCH).alias("n_rx_mcast_mismatch"),
        bad(UCAST_MISMATCH).alias("n_rx_ucast_mismatch"),
    )


def line_rate(df: DataFrame, by: str = "src", period_ns: int = 1_000_000_000) -> DataFrame:
    """Counters of each object and period with their change since its period before: totals, and rates per second."""
    b = df.withColumn("period", whole_div(F.col("ts_ns"), period_ns)).groupBy(by, "period").agg(F.count("*").alias("pkts"), F.sum("frame_len").alias("bytes"))
    total = Window.partitionBy(by).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    gap = (F.col("period") - F.lag("period").over(Window.partitionBy(by).orderBy("period"))) * period_ns
    return b.select(by, "period", F.sum("pkts").over(total).alias("total_pkts"), F.sum("bytes").over(total).alias("total_bytes"), (F.col("pkts") * 1e9 / gap).alias("pps"), (F.col("bytes") * 8e3 / gap).alias("mbps"))


def sliding(df: DataFrame, width_ns: int, step_ns: int) -> DataFrame:
    """Packets and bytes of windows ``width_ns`` long that start every ``step_ns``: aggregated by step before it is put in the windows it belongs to."""
    steps = df.groupBy(whole_div(F.col("ts_ns"), step_ns).alias("_step")).agg(F.count("*").alias("_n"), F.sum("frame_len").alias("_bytes"))
    n = width_ns // step_ns
    each = steps.withColumn("_start", F.explode(F.sequence(F.col("_step") - (n - 1), F.col("_step"))))
    return each.groupBy((F.col("_start") * step_ns).alias("start_ns")).agg(F.sum("_n").alias("pkts"), F.sum("_bytes").alias("bytes"))


def counters(df: DataFrame, by: str = "src", period_ns: int = 1_000_000_000) -> DataFrame:
    """(object, period, field, value): the counters ``pkts`` and ``bytes`` of each object as they stand at the end of each period that has packets."""
    b = df.groupBy(F.col(by).alias("object"), whole_div(F.col("ts_ns"), period_ns).alias("period")).agg(F.count("*").alias("pkts"), F.sum("frame_len").alias("bytes"))
    total = Window.partitionBy("object").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({c: F.sum(c).over(total) for c in ("pkts", "bytes")})
    return b.select("object", "period", F.explode(F.create_map(F.lit("pkts"), "pkts", F.lit("bytes"), "bytes")).alias("field", "value"))


#: What a suffix makes of a counter: its change a second times a factor, or itself times a factor.
RATES = {"rate": 1.0, "pps": 1.0, "mbps": 8e-6}
SCALES = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}


def monitor(table: DataFrame, fields: list[str], period_ns: int = 1_000_000_000) -> DataFrame:
    """A row for each object and period with the fields asked for: ``name``, or ``name.rate``, ``.pps``, ``.mbps`` (change since the object's period before, a second), ``.s``, ``.ms``,
    ``.us``, ``.ns`` (as a time in seconds shown in that unit). A dot in a field becomes ``_``."""
    names = sorted({f.partition(".")[0] for f in fields})
    wide = table.groupBy("object", "period").pivot("field", names).agg(F.first("value"))
    w = Window.partitionBy("object").orderBy("period")
    gap = (F.col("period") - F.lag("period").over(w)) * period_ns / 1e9
    out = {}
    for f in fields:
        name, _, suffix = f.partition(".")
        if suffix and suffix not in RATES | SCALES:
            raise ValueError(f"unknown suffix {suffix!r}")
        change = F.col(name) - F.lag(name).over(w)
        out[f.replace(".", "_")] = F.col(name) if not suffix else change * RATES[suffix] / gap if suffix in RATES else F.col(name) * SCALES[suffix]
    return wide.select("object", "period", *[c.alias(k) for k, c in out.items()])


def check_sequence(df: DataFrame, seq: str = "seq", bits: int = 32) -> DataFrame:
    """Classify steps of a sequence number: ok, gap (with the number missing), repeat, backwards. The first packet is ok."""
    d = with_previous(df, F.col(seq), "_prev")
    step = F.pmod(F.col(seq) - F.col("_prev"), F.lit(1 << bits))
    kind = F.when(F.col("_prev").isNull() | (step == 1), "ok").when(step == 0, "repeat").when(step < 1 << (bits - 1), "gap").otherwise("backwards")
    return d.withColumns({"kind": kind, "missing": F.when(F.col("_prev").isNotNull() & (step > 1) & (step < 1 << (bits - 1)), step - 1).otherwise(0).cast("long")}).drop("_prev")


def mean_gap(df: DataFrame, skip: int = 0) -> DataFrame:
    d = with_previous(df, F.col("ts_ns"), "_prev").where(F.col("_prev").isNotNull() & (F.col("pkt_idx") >= skip))
    return d.agg(F.count("*").alias("gaps"), F.avg(F.col("ts_ns") - F.col("_prev")).alias("mean_ipg_ns"))


def length_check(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("frame_len") < F.col("cap_len")).alias("n_short"), F.count("*").alias("n_pkts"))
