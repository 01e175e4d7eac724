"""Ethernet, VLAN, IPv4, TCP and UDP fields decoded from ``data``; NULL where the bytes aren't there or aren't of that kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes import read_be

ETH_IP, ETH_ARP, ETH_VLAN, ETH_IP6 = 0x0800, 0x0806, 0x8100, 0x86DD
TCP, UDP, ICMP = 6, 17, 1


def decode(data: Column) -> dict[str, Column]:
    outer = read_be(data, 12, 2)
    tagged = outer == ETH_VLAN
    net = F.when(tagged, 18).otherwise(14)
    eth_type = F.when(tagged, read_be(data, 16, 2)).otherwise(outer)
    is_ip = (eth_type == ETH_IP) & (F.length(data) >= net + 20)
    proto = F.when(is_ip, read_be(data, net + 9, 1))
    head = (read_be(data, net, 1).bitwiseAND(15)) * 4
    first = read_be(data, net + 6, 2).bitwiseAND(0x3FFF) == 0
    ports = is_ip & proto.isin(TCP, UDP) & first
    return {
        "dmac": F.lower(F.hex(F.substring(data, 1, 6))),
        "smac": F.lower(F.hex(F.substring(data, 7, 6))),
        "vlan_id": F.when(tagged, read_be(data, 14, 2).bitwiseAND(0xFFF)),
        "eth_type": eth_type,
        "src_ip": F.when(is_ip, read_be(data, net + 12, 4)),
        "dst_ip": F.when(is_ip, read_be(data, net + 16, 4)),
        "ip_proto": proto,
        "sport": F.when(ports, read_be(data, net + head, 2)),
        "dport": F.when(ports, read_be(data, net + head + 2, 2)),
    }


def with_headers(df: DataFrame, data: str = "data") -> DataFrame:
    """Add the fields that ``df`` doesn't have yet."""
    return df.withColumns({k: v for k, v in decode(F.col(data)).items() if k not in df.columns})
