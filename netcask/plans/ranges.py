"""Index ranges (``0-9,20,100-``) and time ranges (``1s-2.5s``, ``+3m``, ``HH:MM:SS``, dates), as predicates on longs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
_UNITS = {"s": NS, "m": 60 * NS, "h": 3600 * NS}


def index_ranges(text: str) -> list[tuple[int, int | None]]:
    """Inclusive, ascending, from 0; an open end is None."""
    out: list[tuple[int, int | None]] = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", part)
        if not m or not (m[1] or m[3]):
            raise ValueError(f"not a range: {part!r}")
        low = int(m[1]) if m[1] else 0
        high = low if not m[2] else int(m[3]) if m[3] else None
        if (high is not None and high < low) or (out and (out[-1][1] is None or low <= out[-1][1])):
            raise ValueError(f"ranges must be in order and apart: {text!r}")
        out.append((low, high))
    return out


def in_ranges(position: Column, text: str) -> Column:
    test = F.lit(False)
    for low, high in index_ranges(text):
        test = test | ((position >= low) if high is None else position.between(low, high))
    return test


@dataclass
class Moment:
    kind: str  # "first" (from the first packet), "start" (from the start), "clock" (time of day), "date"
    ns: int


def moment(text: str) -> Moment:
    if m := re.fullmatch(r"(\+?)(\d+(?:\.\d+)?)([smh])", text):
        return Moment("start" if m[1] else "first", int(Decimal(m[2]) * _UNITS[m[3]]))
    if m := re.fullmatch(r"(\d{1,2}):(\d\d):(\d\d)", text):
        h, mi, s = map(int, m.groups())
        if h > 23 or mi > 59 or s > 60:
            raise ValueError(f"not a time: {text!r}")
        return Moment("clock", (h * 3600 + mi * 60 + s) * NS)
    if m := re.fullmatch(r"(\d{4})[-/](\d\d)[-/](\d\d) (\d\d):(\d\d):(\d\d)", text):
        return Moment("date", int(datetime(*map(int, m.groups()), tzinfo=UTC).timestamp()) * NS)
    raise ValueError(f"not a time: {text!r}")


def time_range(text: str) -> tuple[Moment | None, Moment | None]:
    """``START-END``, either of them may be missing."""
    for i, ch in enumerate(text):  # dates hold the separator too: take the cut at which both sides can be read
        if ch == "-":
            a, b = text[:i].strip(), text[i + 1 :].strip()
            try:
                start, end = (moment(x) if x else None for x in (a, b))
            except ValueError:
                continue
            if start is None and end is None:
                break
            if start is not None and start.kind == "start":
                raise ValueError("a start can't be relative to itself")
            return start, end
    raise ValueError(f"not a time range: {text!r}")


def time_bounds(text: str, first_ns: Column) -> tuple[Column | None, Column | None]:
    """Bounds in ns, inclusive, given the first packet's time. A time of day is on the start's day, or else the first packet's."""
    start, end = time_range(text)
    day = 86400 * NS

    def place(m: Moment | None, base: Column) -> Column | None:
        if m is None:
            return None
        if m.kind == "first":
            return first_ns + m.ns
        if m.kind == "start":
            return base + m.ns
        if m.kind == "clock":
            return base - F.pmod(base, F.lit(day)) + m.ns
        return F.lit(m.ns).cast("long")

    low = place(start, first_ns)
    return low, place(end, first_ns if low is None else low)
