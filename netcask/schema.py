"""The packet row, its flags, and time helpers."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of ``flags``.
CSUM_ERROR, CRC_ERROR, TRUNCATED, MCAST_MISMATCH, UCAST_MISMATCH = 1, 2, 4, 8, 16
FLAG_NAMES = {"csum": CSUM_ERROR, "crc": CRC_ERROR, "trunc": TRUNCATED, "mcast": MCAST_MISMATCH, "ucast": UCAST_MISMATCH}

#: ``pkt_idx`` is the order of arrival; DataFrames have none of their own.
PACKET_SCHEMA = T.StructType(
    [
        T.StructField("pkt_idx", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("frame_len", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def whole_div(a: Column, b) -> Column:
    """Floor division of longs, exact where a double is not."""
    b = F.lit(b) if not isinstance(b, Column) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def times_over(a: Column, n: int, d: int) -> Column:
    """Floor of a * n / d, exact where a * n is more than a long holds: whole d's and the rest are taken apart."""
    n, d = n // math.gcd(n, d), d // math.gcd(n, d)
    rest = F.pmod(a, F.lit(d))
    if n * d < 1 << 63:
        part = whole_div(rest * n, d)
    else:  # both have 19 digits at most
        part = F.call_function("div", rest.cast("decimal(19,0)") * F.lit(Decimal(n)), F.lit(Decimal(d)))
    return whole_div(a, d) * n + part


def seconds_of(ts_ns: Column) -> Column:
    return whole_div(ts_ns, 1_000_000_000)


def nanos_of(ts_ns: Column) -> Column:
    return F.pmod(ts_ns, F.lit(1_000_000_000))


def timestamp_of(ts_ns: Column) -> Column:
    """For watermarks and windows: microseconds, cut off."""
    return F.timestamp_micros(whole_div(ts_ns, 1000))
