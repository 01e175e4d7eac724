"""Reading and building bytes with Column expressions.

A read beyond the end of the data is NULL, never a shorter number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def read_be(data: Column, off, size: int) -> Column:
    """``size`` bytes at ``off`` (from 0) as an unsigned big-endian number."""
    off = _col(off)
    value = F.conv(F.hex(F.substring(data, off + 1, F.lit(size))), 16, 10).cast("long")
    return F.when((off >= 0) & (F.length(data) >= off + size), value)


def read_tail_be(data: Column, back: int, size: int) -> Column:
    """``size`` bytes that start ``back`` bytes before the end."""
    return read_be(data, F.length(data) - back, size)


def hex_be(value, size: int) -> Column:
    """A number as hex digits of ``size`` bytes."""
    return F.lpad(F.hex(_col(value).cast("long")), 2 * size, "0")


def bytes_be(value, size: int) -> Column:
    return F.unhex(hex_be(value, size))


def hex_le(value, size: int) -> Column:
    digits = hex_be(value, size)
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)])


def bytes_le(value, size: int) -> Column:
    return F.unhex(hex_le(value, size))


def splice(data: Column, off, new: Column, size: int) -> Column:
    """``data`` with ``size`` bytes at ``off`` replaced; unchanged if they aren't there."""
    off = _col(off)
    done = F.concat(F.substring(data, F.lit(1), off), new, F.substring(data, off + size + 1, F.length(data)))
    return F.when(F.length(data) >= off + size, done).otherwise(data)


def drop_bytes(data: Column, off: int, size: int) -> Column:
    return F.concat(F.substring(data, 1, off), F.substring(data, F.lit(off + size + 1), F.length(data)))


def ip_number(text: str) -> int:
    parts = [int(x) for x in text.split(".")]
    if len(parts) != 4 or any(not 0 <= x <= 255 for x in parts):
        raise ValueError(f"not an IPv4 address: {text!r}")
    return sum(x << s for x, s in zip(parts, (24, 16, 8, 0), strict=True))


def mac_hex(text: str) -> str:
    digits = "".join(x.rjust(2, "0") for x in text.replace("-", ":").split(":")).upper()
    if len(digits) != 12:
        raise ValueError(f"not a MAC address: {text!r}")
    int(digits, 16)
    return digits
