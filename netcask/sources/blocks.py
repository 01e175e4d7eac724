"""Blocks of packets on several devices, with an index of blocks or of flows; raw bytes in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.balance import KEY, with_flow_key
from ..operators.order import with_position, with_prefix_sum
from ..schema import whole_div

#: Bytes of a record's header in a block, and of a block's.
RECORD, HEADER = 16, 64


def with_blocks(df: DataFrame, block_bytes: int, devices: list[str], device_bytes: int) -> DataFrame:
    """Add ``block_no``, ``device``, ``byte_offset``, ``wraps``: a packet is in the block in which its record begins when records follow one another.

    Blocks are dealt to devices in turn, and written one after another; a device that is full begins anew at its start."""
    per_device = device_bytes // block_bytes
    if per_device < 1:
        raise ValueError("a device holds no block")
    d = with_prefix_sum(df, F.col("cap_len") + RECORD, "_written")
    block = whole_div(F.col("_written"), block_bytes - HEADER)
    d = d.withColumn("block_no", block).drop("_written")
    turn = whole_div(F.col("block_no"), len(devices))
    return d.withColumns(
        {
            "device": F.element_at(F.array(*map(F.lit, devices)), (F.col("block_no") % len(devices) + 1).cast("int")),
            "byte_offset": (turn % per_device) * block_bytes,
            "wraps": whole_div(turn, per_device),
        }
    )


def block_index(blocks: DataFrame) -> DataFrame:
    """A row for each block: where it is, its packets, and their times."""
    d = with_position(blocks, "_pos")
    return d.groupBy("block_no", "device", "byte_offset", "wraps").agg(
        F.min("_pos").alias("pkt_index"), F.count("*").alias("pkt_count"), F.min("ts_ns").alias("start_ns_epoch"), F.max("ts_ns").alias("end_ns_epoch")
    )


def flow_index(blocks: DataFrame) -> DataFrame:
    """A row for each flow in a block."""
    d = with_flow_key(blocks)
    return d.groupBy("block_no", *KEY).agg(F.count("*").alias("pkt_count"), F.sum("cap_len").alias("cap_bytes"), F.min("ts_ns").alias("start_ns_epoch"), F.max("ts_ns").alias("end_ns_epoch"))


def read_chunks(df: DataFrame, size: int, by: str = "path", content: str = "content", repeat: int = 1, repeat_offset: int = 0) -> DataFrame:
    """The bytes of each file in chunks of ``size``, numbered; after the first time a file is read from ``repeat_offset``, ``repeat`` times in all."""
    data = F.col(content)
    turn = F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))
    d = df.select(by, content, turn.alias("turn"))
    start = F.when(F.col("turn") == 0, 0).otherwise(repeat_offset)
    left = F.greatest(F.length(data) - start, F.lit(0))
    n = F.ceil(left / size).cast("int")
    first, again = F.ceil(F.length(data) / size), F.ceil(F.greatest(F.length(data) - repeat_offset, F.lit(0)) / size)
    k = d.withColumns({"_n": n, "_start": start}).where("_n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    number = F.when(F.col("turn") == 0, F.col("_k")).otherwise(first + (F.col("turn") - 1) * again + F.col("_k"))
    return k.select(by, number.cast("long").alias("chunk_no"), F.substring(data, F.col("_start") + F.col("_k") * size + 1, F.lit(size)).alias("data"))


def payloads(df: DataFrame, by: str = "src", width: int = 1 << 16) -> DataFrame:
    """(``by``, part, content): the packets' bytes one after another, in parts of ``width`` index values that together are the stream."""
    part = whole_div(F.col("pkt_idx"), width)
    made = df.groupBy(F.col(by), part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("pkt_idx", F.hex("data").alias("x")))).alias("_rows"))  # a part is bounded
    return made.select(by, "part", F.unhex(F.concat_ws("", F.transform("_rows", lambda r: r["x"]))).alias("content"))
