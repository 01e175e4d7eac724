"""Tick timestamps brought to UTC by keyframes: a state machine over each capture in order."""

from __future__ import annotations

import struct
from copy import copy

import pyarrow as pa
from pyspark.sql import DataFrame

from .order import added, fold

NS, MASK = 1_000_000_000, 0x7FFFFFFF
NO_SYNC, SYNC1, SYNC2, LOST_SYNC = "no_sync", "sync1", "sync2", "lost_sync"


class TickClock:
    """What is known of the ticks: a reference (ticks, UTC, host time) and nanoseconds a tick once two keyframes agree."""

    def __init__(self, nominal_hz: float = 350_000_000.0, max_ppm: float = 50.0, no_sync_ms: int = 60_000, lost_sync_ms: int = 10_000):
        self.nominal, self.ppm, self.no_sync_ns, self.lost_ns = nominal_hz, max_ppm, no_sync_ms * 1_000_000, lost_sync_ms * 1_000_000
        self.state, self.ref, self.freq, self.freq_ref = NO_SYNC, None, None, None

    def keyframe(self, ticks: int, utc: int, host: int) -> None:
        if self.ref and host - self.ref[2] > self.no_sync_ns:
            self.state, self.freq, self.freq_ref = NO_SYNC, None, None
        if self.state != NO_SYNC and self.freq_ref and utc - self.freq_ref[1] >= 0.99 * NS:
            freq = ((ticks - self.freq_ref[0]) % (1 << 64)) * NS / (utc - self.freq_ref[1])
            if abs(freq - self.nominal) > self.nominal * self.ppm / 1e6:
                self.state, self.freq, self.freq_ref = NO_SYNC, None, None
            else:
                self.freq, self.freq_ref = freq, (ticks, utc)
        if self.freq_ref is None:
            self.freq_ref = (ticks, utc)
        self.ref = (ticks, utc, host)
        self.state = SYNC2 if self.freq else SYNC1

    def stamp(self, ticks: int, host: int) -> tuple[str, int | None]:
        """(link, UTC ns): ``""`` in sync, else the name of the link."""
        if self.state in (NO_SYNC, SYNC1) or self.freq is None:
            return NO_SYNC, None
        gap = host - self.ref[2]
        if gap > self.no_sync_ns:
            self.state = NO_SYNC
            return NO_SYNC, None
        self.state = LOST_SYNC if gap > self.lost_ns else SYNC2
        if ticks == 0:
            return "no_timestamp", None
        # long gaps: the reference is moved on by whole turns of the counter, to the one nearest to host time
        base_ticks, base_utc = self.ref[0], self.ref[1]
        moved = int(gap * self.freq / NS)
        near = base_ticks + moved
        delta = (ticks - near) & MASK
        if delta > MASK // 2:
            delta -= MASK + 1
        if delta < -(MASK // 4):
            return "no_timestamp", None
        utc = base_utc + int((moved + delta) * NS / self.freq)
        return ("" if self.state == SYNC2 else LOST_SYNC), utc


def parse_keyframe(payload: bytes) -> tuple[int, int] | None:
    """(ticks, UTC ns) from a keyframe's payload of 46 or 62 bytes: two 64-bit counters lead it."""
    if len(payload) not in (46, 62):
        return None
    ticks, utc = struct.unpack_from(">QQ", payload)
    return ticks, utc


def stamp_ticks(df: DataFrame, by: str = "src", **clock) -> DataFrame:
    """``df`` has pkt_idx, ts_ns (host time), ticks, and for keyframes key_ticks and key_utc_ns. Adds ``link`` and ``utc_ns``."""
    schema = df.selectExpr("*", "'' AS link", "CAST(NULL AS BIGINT) AS utc_ns").schema

    def run(state: TickClock, rows: pa.Table) -> tuple[TickClock, pa.Table]:
        machine = copy(state)
        links, stamps = [], []
        for host, ticks, key, utc in zip(*(rows.column(c).to_pylist() for c in ("ts_ns", "ticks", "key_ticks", "key_utc_ns")), strict=True):
            if key is not None:
                machine.keyframe(int(key), int(utc), int(host))
                link, stamp = "keyframes", None
            else:
                link, stamp = machine.stamp(0 if ticks is None else int(ticks), int(host))
            links.append(link)
            stamps.append(stamp)
        return machine, added(added(rows, "link", pa.array(links, pa.string())), "utc_ns", pa.array(stamps, pa.int64()))

    return fold(df, [by], ["ts_ns", "ticks", "key_ticks", "key_utc_ns"], TickClock(**clock), run, schema)
