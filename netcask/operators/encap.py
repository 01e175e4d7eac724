"""Packets in other packets and in messages: encapsulation, the tunnel's wire format, serialised blocks, connection ids."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import bytes_be, bytes_le, hex_be, ip_number, mac_hex, read_be
from ..functions.draw import draw
from ..schema import nanos_of, seconds_of, whole_div
from .order import WIDTH

NS = 1_000_000_000
# Messages of the tunnel (type, then length of what follows), and the block header.
HANDSHAKE, HANDSHAKE_ACK, LINK, END_OF_LINKS, PACKET, EOS, MAY_IGNORE = 0, 1, 2, 3, 4, 5, 128
PACKET_HEAD, BLOCK_HEAD = "<QIHHHH", "<IIQIHH"


def mode1_encap(df: DataFrame, outer_src: str | None = None, outer_dst: str | None = None, dmac: str = "00:00:00:00:00:00", smac: str = "00:00:00:00:00:00", pad: int = 0, seed: int = 0) -> DataFrame:
    """IP frames (one VLAN tag at most) put behind an outer Ethernet and IPv4 header of protocol 254 and two bytes that tell how much padding follows.
    Other frames are left out. An address that isn't given is drawn from the index; IP ids count in the order of ``pkt_idx``, modulo 65536."""
    d = F.col("data")
    tagged = F.coalesce(read_be(d, 12, 2) == 0x8100, F.lit(False))
    skip = F.when(tagged, 18).otherwise(14)
    kept = df.where(F.coalesce(read_be(d, skip - 2, 2).isin(0x0800, 0x86DD), F.lit(False)))
    from .order import with_position

    e = with_position(kept, "_ip_id")
    inner = F.substring(d, skip + 1, F.length(d))
    src = F.lit(ip_number(outer_src)).cast("long") if outer_src else draw(F.col("pkt_idx"), seed)
    dst = F.lit(ip_number(outer_dst)).cast("long") if outer_dst else draw(F.col("pkt_idx"), seed + 1)
    size = F.col("frame_len") - skip + 22 + pad
    head = F.concat(
        F.lit(mac_hex(dmac) + mac_hex(smac) + "08004500"), hex_be(F.pmod(size, F.lit(65536)), 2), hex_be(F.pmod(F.col("_ip_id"), F.lit(65536)), 2), F.lit("000001FE0000"), hex_be(src, 4), hex_be(dst, 4), hex_be(pad, 2), F.lit("00" * pad)
    )
    return e.withColumns({"data": F.concat(F.unhex(head), inner), "frame_len": size + 14}).drop("_ip_id")


def mode1_decap(df: DataFrame) -> DataFrame:
    """What is in such a packet, as bytes from its IP header on; other packets are left out."""
    d = F.col("data")
    here = (read_be(d, 12, 2) == 0x0800) & (read_be(d, 23, 1) == 254)
    at = 36 + read_be(d, 34, 2)
    return df.where(F.coalesce(here & (F.length(d) >= at), F.lit(False))).withColumns({"data": F.substring(d, at.cast("int") + 1, F.length(d)), "frame_len": F.col("frame_len") - at})


def tunnel_messages(df: DataFrame, stream_col: str = "stream_id") -> DataFrame:
    """Add ``message``: the packet as a tunnel message. Little-endian: type, length of the rest, seconds, nanoseconds, stream, flags, frame length, offset of the payload."""
    size = struct.calcsize(PACKET_HEAD)
    head = F.concat(
        bytes_le(seconds_of(F.col("ts_ns")), 8), bytes_le(nanos_of(F.col("ts_ns")), 4), bytes_le(F.col(stream_col), 2), bytes_le(F.col("flags"), 2), bytes_le(F.pmod(F.col("frame_len"), F.lit(65536)), 2), bytes_le(size, 2)
    )
    return df.withColumn("message", F.concat(bytes_be(PACKET, 1), bytes_le(F.length("data") + size, 4), head, F.col("data")))


def handshake(versions: tuple[int, ...] = (1,), required: int = 0, optional: int = 0) -> bytes:
    body = b"sc_tunnel\0" + bytes(versions[:4]).ljust(4, b"\0") + struct.pack("<II", required, optional)
    return struct.pack("<BI", HANDSHAKE, len(body)) + body


def link_message(name: str, stream_id: int) -> bytes:
    body = struct.pack("<HHIQQ", len(name.encode()) + 1, stream_id, 0, 0, 0) + name.encode() + b"\0"
    return struct.pack("<BI", LINK, len(body)) + body


def end_message(stream_id: int) -> bytes:
    return struct.pack("<BIH", EOS, 2, stream_id)


class TunnelError(ValueError):
    """Not the tunnel's wire format."""


def read_tunnel(blob: bytes) -> Iterator[tuple[int, str | None, int, int, int, bytes]]:
    """(stream, link name, ts_ns, flags, frame_len, data) of the packets in one direction of a connection. Unknown messages that may be ignored are; others, and packets after a stream's end, are errors."""
    at, names, ended = 0, {}, set()
    while at + 5 <= len(blob):
        kind, size = struct.unpack_from("<BI", blob, at)
        body = blob[at + 5 : at + 5 + size]
        if len(body) < size:
            return
        at += 5 + size
        if kind == HANDSHAKE:
            if body[:10] != b"sc_tunnel\0" or struct.unpack_from("<I", body, 14)[0]:
                raise TunnelError("handshake of another protocol, or with options that aren't known")
        elif kind == HANDSHAKE_ACK:
            if struct.unpack_from("<I", body)[0]:
                raise TunnelError(body[4:].split(b"\0")[0].decode("utf-8", "replace"))
        elif kind == LINK:
            length, stream = struct.unpack_from("<HH", body)
            names[stream] = body[24 : 24 + length - 1].decode("utf-8", "replace")
        elif kind == PACKET:
            sec, ns, stream, flags, frame_len, offset = struct.unpack_from(PACKET_HEAD, body)
            if stream in ended:
                raise TunnelError(f"a packet after the end of stream {stream}")
            yield stream, names.get(stream), sec * NS + ns, flags, frame_len, body[offset:]
        elif kind == EOS:
            ended.add(struct.unpack_from("<H", body)[0])
        elif kind < MAY_IGNORE and kind != END_OF_LINKS:
            raise TunnelError(f"unknown message {kind}")


#: Index values of which the messages are a part of a connection; packets that are handed on at a time.
PART = CHUNK = 1 << 14


def connection_parts(df: DataFrame, first: Column, last: Column, by: str = "src", width: int = PART) -> DataFrame:
    """What is sent in one direction of the connections (``by``, part, content): ``first``, the messages in order of ``pkt_idx``, and ``last``, in parts of ``width`` index values that in order
    of their numbers make the whole; ``first`` and ``last`` are columns of ``by``, in parts of their own."""
    made = df.groupBy(by, whole_div(F.col("pkt_idx"), width).alias("part")).agg(F.sort_array(F.collect_list(F.struct("pkt_idx", F.hex("message").alias("x")))).alias("_m"))  # a part is bounded
    body = made.select(by, "part", F.unhex(F.concat_ws("", F.transform("_m", lambda r: r["x"]))).alias("content"))
    ends = df.select(by).distinct().select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("part"), c.alias("content")) for n, c in ((-1, first), ((1 << 63) - 1, last))])).alias("_e"))
    return body.unionByName(ends.select(by, F.col("_e.part").cast("long").alias("part"), "_e.content"))


def control_of(blob: bytes) -> tuple[bytes, int]:
    """The messages that aren't packets, and the number of those that are."""
    at, kept, n = 0, [], 0
    while at + 5 <= len(blob):
        kind, size = struct.unpack_from("<BI", blob, at)
        if at + 5 + size > len(blob):
            break
        if kind == PACKET:
            n += 1
        else:
            kept.append(blob[at : at + 5 + size])
        at += 5 + size
    return b"".join(kept), n


def decode_tunnels(df: DataFrame) -> DataFrame:
    """Packets of the connections in (path, content); ``pkt_idx`` counts in each. With a column ``part`` a row is a part of a connection, cut between messages, and is read apart
    from the others: a first pass counts the packets of each and keeps the messages of other kinds, which go with all later parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [control_of(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c or None for c, _ in seen], pa.binary()), pa.array([n for _, n in seen], pa.int64())], names=["path", "part", "_control", "_n"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for b in batches:
            for r in range(b.num_rows):
                path, blob, control, before = (b.column(c)[r].as_py() for c in range(4))
                rows = ((path, i, *x) for i, x in enumerate(read_tunnel(b"".join(control) + blob if control else blob), before))
                while some := list(islice(rows, CHUNK)):
                    cols = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "pkt_idx", "stream_id", "link", "ts_ns", "flags", "frame_len", "data"])

    if "part" in df.columns:
        d = df.select("path", "part", "content")
        seen = d.mapInArrow(scan, f"path string, part {d.schema['part'].dataType.simpleString()}, _control binary, _n long")
        earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        known = seen.select("path", "part", F.collect_list("_control").over(earlier).alias("_control"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        d = d.join(F.broadcast(known), ["path", "part"])  # a row a part, so that parts stay where they are
    else:
        d = df.withColumns({"_control": F.lit(None).cast("array<binary>"), "_before": F.lit(0).cast("long")})
    return d.select("path", "content", "_control", "_before").mapInArrow(decode, "path string, pkt_idx long, stream_id int, link string, ts_ns long, flags int, frame_len int, data binary")


def serialise(df: DataFrame, block: int = 1 << 16, by: str = "src") -> DataFrame:
    """(``by``, bucket, block_no, block): packets with headers (payload and metadata lengths, seconds, nanoseconds, flags, frame length) one after another, cut in blocks of ``block``
    bytes wherever these end. Each ``WIDTH`` index values begin a new block, so that buckets are made apart."""
    kind = df.schema[by].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("pkt_idx")
        parts = []
        for ts, flags, size, data in zip(*(t.column(c).to_pylist() for c in ("ts_ns", "flags", "frame_len", "data")), strict=True):
            parts += [struct.pack(BLOCK_HEAD, len(data), 0, ts // NS, ts % NS, flags, size % 65536), data]
        whole = b"".join(parts)
        cuts = [whole[a : a + block] for a in range(0, len(whole), block)]
        n = len(cuts)
        return pa.table({by: pa.array([key[0].as_py()] * n, key[0].type), "bucket": pa.array([key[1].as_py()] * n, pa.int64()), "block_no": pa.array(range(n), pa.int32()), "block": pa.array(cuts, pa.binary())})

    d = df.select(by, whole_div(F.col("pkt_idx"), WIDTH).alias("bucket"), "pkt_idx", "ts_ns", "flags", "frame_len", "data")
    return d.groupBy(by, "bucket").applyInArrow(run, f"`{by}` {kind}, bucket long, block_no int, block binary")


def deserialise(df: DataFrame, by: str = "src") -> DataFrame:
    """The packets of such blocks; ``place`` counts in a bucket."""
    kind = df.schema[by].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole = b"".join(table.sort_by("block_no").column("block").to_pylist())
        at, rows = 0, []
        head = struct.calcsize(BLOCK_HEAD)
        while at + head <= len(whole):
            size, extra, sec, ns, flags, frame_len = struct.unpack_from(BLOCK_HEAD, whole, at)
            at += head + extra
            rows.append((sec * NS + ns, flags, frame_len, whole[at : at + size]))
            at += size
        cols = list(zip(*rows, strict=True)) or [()] * 4
        n = len(rows)
        lead = {by: pa.array([key[0].as_py()] * n, key[0].type), "bucket": pa.array([key[1].as_py()] * n, pa.int64()), "place": pa.array(range(n), pa.int64())}
        return pa.table(lead | {c: pa.array(v, k) for c, v, k in zip(("ts_ns", "flags", "frame_len", "data"), cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)})

    return df.groupBy(by, "bucket").applyInArrow(run, f"`{by}` {kind}, bucket long, place long, ts_ns long, flags int, frame_len int, data binary")


def connection_ids(df: DataFrame, control: DataFrame, first: int = 0) -> DataFrame:
    """Add ``connection_id``: that of the last control message (ts_ns, connection_id) before the packet or at its time; ``first`` before any.

    The control table is cut in seconds, and the last message before each second carried, so no window is over the whole input."""
    c = control.select(F.col("ts_ns").alias("_at"), F.col("connection_id").cast("long").alias("_id")).withColumn("_sec", seconds_of(F.col("_at")))
    both = df.withColumns({"_sec": seconds_of(F.col("ts_ns")), "_set": F.lit(None).cast("long"), "_kind": F.lit(1)}).unionByName(
        c.select(F.col("_at").alias("ts_ns"), "_sec", F.col("_id").alias("_set"), F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    ends = both.groupBy("_sec").agg(F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("ts_ns"))).alias("_end"))
    before = ends.select("_sec", F.last("_end", ignorenulls=True).over(Window.orderBy("_sec").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row a second
    inside = Window.partitionBy("_sec").orderBy("ts_ns", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    d = both.join(before, "_sec").withColumn("connection_id", F.coalesce(F.last("_set", ignorenulls=True).over(inside), "_before", F.lit(first)).cast("long"))
    return d.where("_kind = 1").drop("_sec", "_set", "_kind", "_before")


def drop_tcp_segment(df: DataFrame, times: int = 1, after: int = 0, by: tuple[str, ...] = ("src_ip", "dst_ip", "sport", "dport")) -> dict[str, DataFrame]:
    """``drop``: of each TCP connection the first ``times`` packets that carry the sequence number of its packet number ``after`` (from 0); ``""``: all others."""
    seq = read_be(F.col("data"), F.when(F.col("vlan_id").isNull(), 38).otherwise(42), 4)
    tcp = df.where("ip_proto = 6").withColumn("_seq", seq)
    first = tcp.select(*by, "pkt_idx", "_seq").groupBy(*by).agg(F.slice(F.sort_array(F.collect_list(F.struct("pkt_idx", "_seq"))), after + 1, 1).alias("_pick")) if after else tcp.groupBy(*by).agg(
        F.array(F.min(F.struct("pkt_idx", "_seq"))).alias("_pick")
    )
    chosen = first.where(F.size("_pick") > 0).select(*by, F.col("_pick")[0]["_seq"].alias("_seq"), F.col("_pick")[0]["pkt_idx"].alias("_from"))
    same = tcp.join(chosen, [*by, "_seq"]).where(F.col("pkt_idx") >= F.col("_from"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("pkt_idx"))
    gone = same.select("pkt_idx", nth.alias("_n")).where(F.col("_n") <= times).select("pkt_idx")
    return {"drop": df.join(gone, "pkt_idx", "left_semi"), "": df.join(gone, "pkt_idx", "left_anti")}


def scatter(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Add ``output``: drawn from the index, of ``n``."""
    return df.withColumn("output", F.pmod(draw(F.col("pkt_idx"), seed), F.lit(n)))
