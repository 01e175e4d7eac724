"""Packed-stream buffers: many packets in one blob, each behind a 16-byte little-endian header."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import states
from ..schema import CRC_ERROR, CSUM_ERROR, whole_div

HEADER = struct.Struct("<HBBHHII")  # next offset, packet start, flags, captured, original, seconds, nanoseconds
NS = 1_000_000_000
#: Flags of a header: bad FCS, bad checksums of layers 4 and 3.
BAD_FCS, BAD_L4, BAD_L3 = 4, 8, 16


def unpack(blob: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(ts_ns, flags, frame_len, data); a next offset of zero ends the buffer."""
    at = 0
    while at + HEADER.size <= len(blob):
        step, start, flags, size, length, sec, ns = HEADER.unpack_from(blob, at)
        mapped = (CRC_ERROR if flags & BAD_FCS else 0) | (CSUM_ERROR if flags & (BAD_L3 | BAD_L4) else 0)
        yield sec * NS + ns, mapped, length, blob[at + start : at + start + size]
        if step == 0:
            return
        at += step


def pack(rows: Iterator[tuple[int, int, bytes]], buf_size: int) -> Iterator[bytes]:
    """Greedy: a new buffer where the next packet and its header don't fit. Flags are written as zero."""
    parts: list[bytes] = []
    held = 0
    for ts, length, data in rows:
        need = HEADER.size + len(data)
        if parts and held + need > buf_size:
            yield _closed(parts)
            parts, held = [], 0
        sec, ns = divmod(ts, NS)
        parts.append(HEADER.pack(need, HEADER.size, 0, len(data), min(length, 65535), sec, ns) + data)
        held += need
    if parts:
        yield _closed(parts)


def _closed(parts: list[bytes]) -> bytes:
    return b"".join(parts[:-1]) + b"\0\0" + parts[-1][2:]


#: Index values of which the packets are made to buffers together.
PART = 1 << 14
#: Packets that are handed on at a time.
CHUNK = 1 << 14


def pack_stream(df: DataFrame, buf_size: int = 1 << 16, by: str = "src", width: int = PART) -> DataFrame:
    """(by, buffer_no, buffer) from packets, in order of pkt_idx for each value of ``by``.

    Where a buffer ends depends on where it began. A fold over the sizes alone finds for each stretch of ``width`` index values the first packet there that begins a buffer, and the
    number of that buffer; packets before it are in one begun in an earlier stretch. Then the buffers that begin in a stretch are made, stretches apart."""
    last, head = (1 << 63) - 1, HEADER.size

    def cut(state: tuple, rows: pa.Table) -> tuple[tuple, None]:
        """Number of the next buffer, bytes in the open one; the stretch, its first packet that begins a buffer, and that one's number; stretch and number of the last such; last index."""
        number, held, stretch, first, new, home, base, index = state
        if stretch != (here := rows.column("_bucket")[0].as_py()):
            stretch, first, new = here, None, None
        at, before, places = 0, 0, pc.fill_null(rows.column("pkt_idx"), last).to_numpy()
        ends = np.cumsum(head + pc.fill_null(rows.column("_size"), 0).to_numpy().astype(np.int64))
        while at < len(ends):
            fit = int(np.searchsorted(ends, buf_size - held + before, "right"))
            if number and fit > at:
                held, before, at = held + int(ends[fit - 1]) - before, int(ends[fit - 1]), fit
                continue
            if first is None and places[at] != (places[at - 1] if at else index):  # packets of one index stay together
                first, new = int(places[at]), number
                home, base = stretch, number
            number, held = number + 1, int(ends[at]) - before
            before, at = int(ends[at]), at + 1
        return (number, held, stretch, first, new, home, base, int(places[-1])), None

    sized = df.withColumn("_size", F.length("data"))
    kinds = "_first long, _new long, _home long, _base long"
    known = states(sized, [by], ["_size"], (0, 0, None, None, None, None, None, None), cut, width=width, kinds=kinds, tell=lambda before, after: (*after[3:5], *before[5:7]))
    d = sized.select(by, "pkt_idx", "ts_ns", "frame_len", "data", "_size", F.coalesce("pkt_idx", F.lit(last)).alias("_at"))
    d = d.withColumn("_stretch", whole_div(F.col("_at"), width)).join(known.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_stretch") == F.col("_bucket")))
    earlier = F.col("_first").isNull() | (F.col("_at") < F.col("_first"))
    d = d.select(
        by, "pkt_idx", "ts_ns", "frame_len", "data", "_size", F.when(earlier, F.col("_home")).otherwise(F.col("_stretch")).alias("_home"), F.when(earlier, F.col("_base")).otherwise(F.col("_new")).alias("_base")
    )

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("pkt_idx", "ascending"), ("_size", "ascending")])
        rows = zip(*(t.column(c).to_pylist() for c in ("ts_ns", "frame_len", "data")), strict=True)
        out = list(pack(rows, buf_size))
        base = t.column("_base")[0].as_py()
        return pa.table({by: pa.array([t.column(by)[0].as_py()] * len(out), t.schema.field(by).type), "buffer_no": pa.array(range(base, base + len(out)), pa.int64()), "buffer": pa.array(out, pa.binary())})

    return d.groupBy(by, "_home").applyInArrow(run, f"`{by}` {df.schema[by].dataType.simpleString()}, buffer_no long, buffer binary")


def unpack_stream(df: DataFrame, by: str = "src") -> DataFrame:
    """Packets with the number of their buffer and their place in it."""
    kind = df.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = (b.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            rows = ((s, n, i, *p) for s, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) for i, p in enumerate(unpack(blob.as_py())))
            while some := list(islice(rows, CHUNK)):
                cols = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[by, "buffer_no", "place", "ts_ns", "flags", "frame_len", "data"])

    return df.select(by, "buffer_no", "buffer").mapInArrow(run, f"`{by}` {kind}, buffer_no long, place int, ts_ns long, flags int, frame_len int, data binary")


def repack_stream(df: DataFrame, buf_size: int = 1 << 20, by: str = "src", buffers: int = 64) -> DataFrame:
    """Buffers of another size with the same packets, in order; the packets of ``buffers`` buffers are made to new ones together."""
    index = F.shiftleft("buffer_no", 32) + F.col("place")
    return pack_stream(unpack_stream(df, by).withColumn("pkt_idx", index), buf_size, by, buffers << 32)
