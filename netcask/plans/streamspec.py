"""Stream specifications (``udp:10.0.0.1:80``, ``eth:vid=5,00:11:..``, ``dhost=..,tcp``) as predicates on decoded header columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytes import ip_number, mac_hex
from ..schema import MCAST_MISMATCH, UCAST_MISMATCH

_PROTO = {"tcp": 6, "udp": 17}
_TYPES = {"ip": 0x0800, "arp": 0x0806}


def _number(text: str, most: int) -> int:
    n = int(text, 0)
    if not 0 <= n <= most:
        raise ValueError(f"out of range: {text!r}")
    return n


def fields(spec: str) -> dict[str, object]:
    """The fields that a single specification fixes."""
    spec = spec.strip()
    if spec in ("all", "mismatch"):
        return {spec: True}
    head, colon, rest = spec.partition(":")
    out: dict[str, object] = {}
    if colon and head == "eth":
        parts = [p.strip() for p in rest.split(",")]
        if parts[0].startswith("vid="):
            out["vid"] = _number(parts.pop(0)[4:], 0xFFF)
        if len(parts) != 1:
            raise ValueError(f"eth wants one address: {spec!r}")
        return out | {"dmac": mac_hex(parts[0]).lower()}
    if colon and head in _PROTO:
        out["ip_protocol"] = _PROTO[head]
        parts = [p.strip() for p in rest.split(",")]
        if parts[0].startswith("vid="):
            out["vid"] = _number(parts.pop(0)[4:], 0xFFF)
        if not 1 <= len(parts) <= 2:
            raise ValueError(f"{head} wants one or two ends: {spec!r}")
        for names, end in zip((("dhost", "dport"), ("shost", "sport")), parts, strict=False):
            host, sep, port = end.rpartition(":")
            if not sep:
                raise ValueError(f"no port in {end!r}")
            out[names[0]], out[names[1]] = ip_number(host), _number(port, 65535)
        return out
    for part in spec.split(","):
        key, eq, value = (x.strip() for x in part.partition("="))
        if not eq and key in _PROTO:
            out["ip_protocol"] = _PROTO[key]
        elif not eq and key == "ip":
            out["eth_type"] = 0x0800
        elif key in ("dmac", "smac"):
            out[key] = mac_hex(value).lower()
        elif key == "vid":
            out[key] = _number(value, 0xFFF)
        elif key == "eth_type":
            out[key] = _TYPES[value] if value in _TYPES else _number(value, 0xFFFF)
        elif key in ("shost", "dhost"):
            out[key] = ip_number(value)
        elif key == "ip_protocol":
            out[key] = _PROTO[value] if value in _PROTO else _number(value, 255)
        elif key in ("sport", "dport"):
            out[key] = _number(value, 65535)
        else:
            raise ValueError(f"unknown field {part!r}")
    return out


#: Field of a specification to column of ``functions.headers``.
COLUMNS = {"dmac": "dmac", "smac": "smac", "vid": "vlan_id", "eth_type": "eth_type", "shost": "src_ip", "dhost": "dst_ip", "ip_protocol": "ip_proto", "sport": "sport", "dport": "dport"}


def _one(spec: str) -> Column | None:
    f = fields(spec)
    if "all" in f:
        return None
    if "mismatch" in f:
        return F.col("flags").bitwiseAND(MCAST_MISMATCH | UCAST_MISMATCH) != 0
    tests = [F.coalesce(F.col(COLUMNS[k]) == v, F.lit(False)) for k, v in f.items()]
    return reduce(Column.__and__, tests)


def stream_predicate(spec: str) -> Column:
    """Specifications apart by ``;`` are alternatives; ``all`` is what none of the others takes, so with any of them it is everything."""
    tests = [_one(s) for s in spec.split(";") if s.strip()]
    if not tests:
        raise ValueError("empty specification")
    if None in [None if t is None else 0 for t in tests]:
        return F.lit(True)
    return reduce(Column.__or__, tests)
