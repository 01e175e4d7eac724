"""The same steps on unbounded input, where they don't need its end.

Filters, edits and decoders are the batch functions: they work row by row. Here are those that keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.balance import KEY, with_flow_key
from ..schema import timestamp_of

NS = 1_000_000_000


def with_event_time(df: DataFrame, late: str = "10 seconds") -> DataFrame:
    return df.withColumn("ts", timestamp_of(F.col("ts_ns"))).withWatermark("ts", late)


def rates(df: DataFrame, period: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Packets and bytes by tumbling window; a window is given out once the watermark has passed it."""
    w = with_event_time(df, late).groupBy(F.window("ts", period))
    return w.agg(F.count("*").alias("pkts"), F.sum("cap_len").alias("cap_bytes"), F.sum("frame_len").alias("link_bytes")).select(F.col("window.start").alias("start"), "pkts", "cap_bytes", "link_bytes")


def flow_sessions(df: DataFrame, idle: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Flows by session window: a gap of ``idle`` ends one."""
    keyed = with_flow_key(with_event_time(df, late))
    return keyed.groupBy(*KEY, F.session_window("ts", idle)).agg(F.count("*").alias("pkts"), F.sum("frame_len").alias("link_bytes")).select(*KEY, F.col("session_window.start").alias("start"), "pkts", "link_bytes")


def sequence_check(df: DataFrame, by: str = "src", seq: str = "seq", bits: int = 32) -> DataFrame:
    """Steps of a sequence number by ``by``, across batches. Rows of a batch are taken in order of pkt_idx."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("pkt_idx")
        last = state.get[0] if state.exists else None
        kinds = []
        for s in rows[seq]:
            step = None if last is None else (int(s) - last) % (1 << bits)
            kinds.append("ok" if step in (None, 1) else "repeat" if step == 0 else "gap" if step < 1 << (bits - 1) else "backwards")
            last = int(s)
        state.update((last,))
        yield pd.DataFrame({by: key[0], "pkt_idx": rows["pkt_idx"], "kind": kinds})

    return df.groupBy(by).applyInPandasWithState(run, f"`{by}` long, pkt_idx long, kind string", "last long", "append", GroupStateTimeout.NoTimeout)


def refuse_streaming(df: DataFrame, what: str) -> None:
    """Positional steps need the whole input: run them in ``foreachBatch``, or on a finished one."""
    if df.isStreaming:
        raise ValueError(f"{what} needs the end of its input; use it in foreachBatch")
