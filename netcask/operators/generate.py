"""Packets made from nothing: header fields fixed, cycling through a range, or drawn from one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import bytes_be, hex_be, ip_number, mac_hex

NS = 1_000_000_000


def field_value(spec: str | int, index: Column, ip: bool = False) -> Column:
    """``a``; ``a-b`` cycles, with the index; ``ra-b`` is drawn by a hash of it; an address with a mask length cycles through its network."""
    def number(t: str) -> int:
        return ip_number(t) if ip and "." in t else int(t, 0)

    text = str(spec)
    drawn = text.startswith("r")
    text = text.removeprefix("r")
    if "/" in text:
        base, bits = text.split("/")
        size = 1 << (32 - int(bits))
        low = number(base) // size * size
        high = low + size - 1
    elif "-" in text:
        low, high = map(number, text.split("-"))
    else:
        low = high = number(text)
    if high < low:
        raise ValueError(f"not a range: {spec!r}")
    if high == low:
        return F.lit(low).cast("long")
    n = high - low + 1
    return F.lit(low).cast("long") + (F.pmod(F.xxhash64(index, F.lit(str(spec))), F.lit(n)) if drawn else index % n)


FIELDS = {
    "dmac": "00:11:22:33:44:55", "smac": "00:66:77:88:99:AA", "src_ip": "1.2.3.4", "dst_ip": "1.2.3.5", "sport": 0x1234, "dport": 0x5678, "ttl": 0xFF, "vlan_id": None, "vlan_pcp": 0,
    "tos": 0, "ip_id": 0, "frag_off": 0, "tcp_seq": 0, "tcp_ack": 0, "tcp_flags": 0x10, "tcp_window": 0, "tcp_urgent": 0,
}


def generate(spark: SparkSession, n: int, size: int = 60, pps: int | None = None, start_ns: int = 0, protocol: str = "udp", bw: int | None = None, **fields: str | int) -> DataFrame:
    """``n`` Ethernet frames with IPv4 and UDP or TCP; a 64-bit sequence number follows the headers. Defaults (``FIELDS``) are those of a plain test packet. ``bw``: bits a
    second of frames, where ``pps`` isn't given."""
    if unknown := set(fields) - set(FIELDS):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    d = FIELDS | fields
    i = F.col("id")
    num = {k: field_value(d[k], i) for k in ("tos", "ip_id", "frag_off", "vlan_pcp", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", "tcp_urgent")}
    src, dst = field_value(d["src_ip"], i, True), field_value(d["dst_ip"], i, True)
    sport, dport, ttl = (field_value(d[k], i) for k in ("sport", "dport", "ttl"))
    tag = F.lit("") if d["vlan_id"] is None else F.concat(F.lit("8100"), hex_be(num["vlan_pcp"] * 8192 + field_value(d["vlan_id"], i), 2))
    net = 14 if d["vlan_id"] is None else 18
    tcp = protocol == "tcp"
    ip = F.concat(F.lit("45"), hex_be(num["tos"], 1), hex_be(size - net, 2), hex_be(num["ip_id"], 2), hex_be(num["frag_off"], 2), hex_be(ttl, 1), F.lit("06" if tcp else "11"), F.lit("0000"), hex_be(src, 4), hex_be(dst, 4))
    rest = F.concat(hex_be(num["tcp_seq"], 4), hex_be(num["tcp_ack"], 4), F.lit("50"), hex_be(num["tcp_flags"], 1), hex_be(num["tcp_window"], 2), F.lit("0000"), hex_be(num["tcp_urgent"], 2))
    l4 = F.concat(hex_be(sport, 2), hex_be(dport, 2), rest if tcp else F.concat(hex_be(size - net - 20, 2), F.lit("0000")))
    head = F.concat(F.lit(mac_hex(d["dmac"]) + mac_hex(d["smac"])), tag, F.lit("0800"), ip, l4, hex_be(i, 8))
    return spark.range(n).select(
        i.alias("pkt_idx"),
        (start_ns + F.expr(f"(id * {NS}) div {int(pps)}") if pps else start_ns + F.expr(f"(id * {8 * size * NS}L) div {int(bw)}") if bw else F.lit(start_ns).cast("long")).alias("ts_ns"),
        F.lit(0).alias("flags"),
        F.lit(size).alias("frame_len"),
        src.alias("src_ip"),
        dst.alias("dst_ip"),
        sport.alias("sport"),
        dport.alias("dport"),
        F.unhex(F.rpad(head, 2 * size, "0")).alias("data"),
    )


def with_sequence(df: DataFrame, off: int, size: int = 4) -> DataFrame:
    from ..functions.bytes import splice

    return df.withColumn("data", splice(F.col("data"), off, bytes_be(F.col("pkt_idx") % (1 << 8 * size), size), size))
