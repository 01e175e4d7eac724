"""Steps that change payloads. Checksums are left as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import bytes_be, drop_bytes, ip_number, mac_hex, read_be, splice
from ..functions.headers import ETH_IP, ETH_VLAN


def snap(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("data", F.substring("data", 1, size))


def strip_vlan(df: DataFrame, tpid: int = ETH_VLAN) -> DataFrame:
    """Tagged frames lose the four bytes of the tag, and four from their length."""
    tagged = F.coalesce((read_be(F.col("data"), 12, 2) == tpid) & (F.length("data") >= 16), F.lit(False))
    return df.withColumns({"frame_len": F.when(tagged, F.col("frame_len") - 4).otherwise(F.col("frame_len")), "data": F.when(tagged, drop_bytes(F.col("data"), 12, 4)).otherwise(F.col("data"))})


def edit_headers(df: DataFrame, ip_source: str | None = None, ip_dest: str | None = None, dmac: str | None = None, udp_source: int | None = None, udp_dest: int | None = None) -> DataFrame:
    """Rewrite fields of IPv4 frames with at most one VLAN tag."""
    data = F.col("data")
    tagged = read_be(data, 12, 2) == ETH_VLAN
    net = F.when(tagged, 18).otherwise(14)
    is_ip = F.coalesce(F.when(tagged, read_be(data, 16, 2)).otherwise(read_be(data, 12, 2)) == ETH_IP, F.lit(False))
    is_udp = is_ip & F.coalesce(read_be(data, net + 9, 1) == 17, F.lit(False))
    new: Column = data
    if dmac is not None:
        new = splice(new, 0, F.unhex(F.lit(mac_hex(dmac))), 6)
    for text, off in ((ip_source, 12), (ip_dest, 16)):
        if text is not None:
            new = splice(new, net + off, bytes_be(ip_number(text), 4), 4)
    transport = net + F.coalesce(read_be(data, net, 1).bitwiseAND(15) * 4, F.lit(20))
    for port, off in ((udp_source, 0), (udp_dest, 2)):
        if port is not None:
            new = F.when(is_udp, splice(new, transport + off, bytes_be(port, 2), 2)).otherwise(new)
    return df.withColumn("data", F.when(is_ip, new).otherwise(data))


def reflect(df: DataFrame) -> DataFrame:
    """Source and destination MAC change places."""
    d = F.col("data")
    turned = F.concat(F.substring(d, 7, 6), F.substring(d, 1, 6), F.substring(d, F.lit(13), F.length(d)))
    return df.withColumn("data", F.when(F.length(d) >= 12, turned).otherwise(d))


def append_timestamp(df: DataFrame) -> DataFrame:
    """Seconds and nanoseconds, 32 bits each, most significant byte first."""
    ns = F.pmod(F.col("ts_ns"), F.lit(1_000_000_000))
    sec = F.call_function("div", F.col("ts_ns") - ns, F.lit(1_000_000_000))
    return df.withColumns({"data": F.concat("data", bytes_be(sec, 4), bytes_be(ns, 4)), "frame_len": F.col("frame_len") + 8})


def hexdump(df: DataFrame) -> DataFrame:
    return df.select("pkt_idx", F.lower(F.hex("data")).alias("hex"))
