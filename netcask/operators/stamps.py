"""Hardware timestamps carried in frames, decoded with Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import bytes_be, bytes_le, drop_bytes, mac_hex, read_be, read_tail_be, splice
from ..schema import CRC_ERROR, seconds_of
from .order import with_last_known

NS = 1_000_000_000


def vss(df: DataFrame, strip: bool = True, timestamp: bool = True, portstamp: bool = True) -> DataFrame:
    """Trailer: seconds, nanoseconds (low 30 bits), port. Adds ``port``, by which packets are routed."""
    size = 8 * timestamp + portstamp
    d = F.col("data")
    whole = F.length(d) >= size
    new = {}
    if timestamp:
        new["ts_ns"] = F.when(whole, read_tail_be(d, size, 4) * NS + read_tail_be(d, size - 4, 4).bitwiseAND(0x3FFFFFFF)).otherwise(F.col("ts_ns"))
    new["port"] = F.when(whole, read_tail_be(d, 1, 1)) if portstamp else F.lit(None).cast("long")
    if strip:
        new["data"] = F.when(whole, F.substring(d, F.lit(1), F.length(d) - size)).otherwise(d)
        new["frame_len"] = F.when(whole, F.col("frame_len") - size).otherwise(F.col("frame_len"))
    return df.withColumns(new)


# Bits of the footer's version byte and of an extension's header word.
EXTENDED, FCS_VALID, FINAL, TAG, SECONDARY = 2, 1, 0x20, 0x1F, 0x1F


def extension_length(data: Column, offset: int, size: Column) -> Column:
    """Bytes of the extensions that end ``offset`` bytes before the end. Read backwards: a header word tells how many words stand before it, and whether it is
    the final one; 0 if none is before the start of the frame."""

    def step(acc: Column, _: Column) -> Column:
        word = read_tail_be(data, F.lit(offset + 4) + acc["n"], 4)
        more = F.when(word.bitwiseAND(TAG) == SECONDARY, F.shiftright(word, 6).bitwiseAND(0x3FF) + 1).otherwise(F.shiftright(word, 6).bitwiseAND(3))
        read = ~acc["done"] & (size > F.lit(offset + 4) + acc["n"]) & word.isNotNull()
        return F.struct(
            F.when(read, acc["n"] + 4 * (more + 1)).otherwise(acc["n"]).cast("long").alias("n"),
            (acc["done"] | (read & (word.bitwiseAND(FINAL) != 0))).alias("done"),
        )

    words = F.sequence(F.lit(1), F.greatest(F.lit(1), F.call_function("div", size, F.lit(4)).cast("int")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("done"))
    return F.aggregate(words, start, step, lambda acc: F.when(acc["done"], acc["n"]).otherwise(0))


def footer_stamp(df: DataFrame, has_fcs: bool = True, strip: bool = True, max_diff_ns: int | None = None, extensions: bool = False) -> DataFrame:
    """Footer: old FCS, seconds, nanoseconds, version, device, port (16 bytes), and a new FCS where there is one. Adds ``device_id`` and ``port``. Packets with
    a CRC error, with 10^9 nanoseconds or more, or too far from their own time pass unchanged. ``extensions``: those that the version byte announces go with
    the footer, and unless it says that the old FCS was valid the packet gets a CRC error; both only where the footer is taken off."""
    d = F.col("data")
    fcs = 4 if has_fcs else 0
    sec, ns = read_tail_be(d, fcs + 12, 4), read_tail_be(d, fcs + 8, 4)
    stamp = sec * NS + ns
    good = (F.length(d) >= 16 + fcs) & (F.col("flags").bitwiseAND(CRC_ERROR) == 0) & (ns < NS)
    if max_diff_ns is not None:
        good = good & (F.abs(stamp - F.col("ts_ns")) <= max_diff_ns)
    good = F.coalesce(good, F.lit(False))
    new = {"ts_ns": F.when(good, stamp).otherwise(F.col("ts_ns")), "device_id": F.when(good, read_tail_be(d, fcs + 3, 2)), "port": F.when(good, read_tail_be(d, fcs + 1, 1))}
    if strip:  # sixteen bytes always, so the old FCS stays where there was a new one
        gone = F.lit(16).cast("long")
        if extensions:
            version = read_tail_be(d, fcs + 4, 1)
            has = good & (version.bitwiseAND(EXTENDED) != 0)
            gone = gone + F.when(has, extension_length(d, fcs + 12, F.col("frame_len"))).otherwise(0)
            new["flags"] = F.when(has & (version.bitwiseAND(FCS_VALID) == 0), F.col("flags").bitwiseOR(CRC_ERROR)).otherwise(F.col("flags"))
        new["data"] = F.when(good, F.substring(d, F.lit(1), (F.length(d) - gone).cast("int"))).otherwise(d)
        new["frame_len"] = F.when(good, F.col("frame_len") - gone).otherwise(F.col("frame_len"))
    return df.withColumns(new)


def footer_encap(df: DataFrame, version: int = 0, device_id: int = 0, port: int = 0, has_fcs: bool = False) -> DataFrame:
    """Append such a footer: the FCS is computed where the frame has none, one off for frames with a CRC error."""
    d = F.col("data")
    crc = F.pmod(F.crc32(d) + F.when(F.col("flags").bitwiseAND(CRC_ERROR) != 0, 1).otherwise(0), F.lit(1 << 32))
    parts = [] if has_fcs else [bytes_le(crc, 4)]
    foot = F.concat(*parts, bytes_be(seconds_of(F.col("ts_ns")), 4), bytes_be(F.pmod(F.col("ts_ns"), F.lit(NS)), 4), bytes_be(version, 1), bytes_be(device_id, 2), bytes_be(port, 1))
    return df.withColumns({"data": F.concat(d, foot), "frame_len": F.col("frame_len") + (12 if has_fcs else 16)})


# Ethernet type, subtype and versions of the switch headers.
SWITCH_TYPE, SWITCH_SUBTYPE = 0xD28B, 1
V48, V64 = (0x20, 0x120, 0x21, 0x121), (0x10, 0x110, 0x11, 0x111)


def _switch_header(versions: tuple[int, ...], size: int):
    d = F.col("data")
    return F.coalesce((read_be(d, 12, 2) == SWITCH_TYPE) & (read_be(d, 14, 2) == SWITCH_SUBTYPE) & read_be(d, 16, 2).isin(*versions) & (F.length(d) >= 12 + size), F.lit(False))


def switch48(df: DataFrame, strip: bool = True, in_source: bool = False, new_source: str | None = None, no_stamp_oui: str | None = None) -> DataFrame:
    """16 bits of seconds, 32 of nanoseconds; the upper seconds come from the packet's own time, to the nearest. Adds ``stamped``, and ``rollover``: whether
    these differ from the own time's.

    They stand behind the addresses, or (``in_source``; then nothing is stripped) in the source address, which ``new_source`` replaces. LLDP, packets from
    ``no_stamp_oui``, with a CRC error, too short, or with 10^9 nanoseconds or more have no stamp."""
    if in_source and strip:
        raise ValueError("nothing can be stripped where the stamp is in the source address")
    d = F.col("data")
    at = 6 if in_source else 18
    here = (F.length(d) >= 14) if in_source else _switch_header(V48, 12)
    if no_stamp_oui is not None:
        oui = int("".join(x.rjust(2, "0") for x in no_stamp_oui.split(":")), 16)
        here = here & F.coalesce(read_be(d, 6, 3) != oui, F.lit(True))
    lldp = F.coalesce(read_be(d, 12, 2) == 0x88CC, F.lit(False))
    here = here & ~lldp & (F.col("flags").bitwiseAND(CRC_ERROR) == 0) & F.coalesce(read_be(d, at + 2, 4) < NS, F.lit(False))
    host = seconds_of(F.col("ts_ns"))
    delta = F.pmod(read_be(d, at, 2) - host.bitwiseAND(0xFFFF), F.lit(65536))
    sec = host + F.when(delta >= 32768, delta - 65536).otherwise(delta)
    rolled = here & (F.shiftright(sec, 16) != F.shiftright(host, 16))
    out = _stamped(df.withColumn("rollover", F.coalesce(rolled, F.lit(False))), here, sec * NS + read_be(d, at + 2, 4), strip, 12)
    if new_source is not None:
        out = out.withColumn("data", F.when(F.col("stamped"), splice(F.col("data"), 6, F.unhex(F.lit(mac_hex(new_source))), 6)).otherwise(F.col("data")))
    return out


def switch_stamps(df: DataFrame, switch_model: str = "7150", ts_format: str | None = None, **args) -> dict[str, DataFrame]:
    """By model (``7150`` of none is given) and, for ``7280``, format (``48bit`` if none is given): ``""`` packets with the switch's time, ``no_timestamp``, ``lldp``
    (always empty for ``7280``: these go the second way), and for ``7150`` ``keyframes``, ``no_sync`` and ``lost_sync``."""
    if switch_model == "7150":
        if ts_format is not None:
            raise ValueError("7150 has one format")
        from .ticks import stamp_ticks

        done = stamp_ticks(df, **args)
        return {link: done.where(F.col("link") == link) for link in ("", "no_timestamp", "lldp", "keyframes", "no_sync", "lost_sync")}
    if switch_model != "7280":
        raise ValueError(f"unknown model {switch_model!r}")
    if ts_format not in (None, "48bit", "64bit"):
        raise ValueError(f"unknown format {ts_format!r}")
    done = (switch64 if ts_format == "64bit" else switch48)(df, **args)
    return {"": done.where("stamped"), "no_timestamp": done.where(~F.col("stamped")), "lldp": done.where(F.lit(False))}


def switch64(df: DataFrame, strip: bool = True, window_ns: int = 0, by: str = "src") -> DataFrame:
    """32 bits each. Near a rollover of the 4 s cycle (within ``window_ns`` of its end) the seconds may be one cycle off: of both
    readings that one is taken which is nearer to the packet's time less the last good difference. Adds ``stamped``."""
    d = F.col("data")
    here = _switch_header(V64, 14)
    t = read_be(d, 18, 4) * NS + read_be(d, 22, 4)
    if not window_ns:
        return _stamped(df, here, t, strip, 14)
    near = here & (F.pmod(t, F.lit(4 * NS)) >= 4 * NS - window_ns)
    e = with_last_known(df, F.when(here & ~near, F.col("ts_ns") - t), "_delta", by)
    expected = F.col("ts_ns") - F.coalesce("_delta", F.lit(0))
    back = t - 4 * NS
    fixed = F.when(near & (F.abs(expected - back) < F.abs(expected - t)), back).otherwise(t)
    return _stamped(e, here, fixed, strip, 14).drop("_delta")


def _stamped(df: DataFrame, here, ts, strip: bool, size: int) -> DataFrame:
    new = {"stamped": here, "ts_ns": F.when(here, ts).otherwise(F.col("ts_ns"))}
    if strip:
        new["data"] = F.when(here, drop_bytes(F.col("data"), 12, size)).otherwise(F.col("data"))
        new["frame_len"] = F.when(here, F.col("frame_len") - size).otherwise(F.col("frame_len"))
    return df.withColumns(new)


def switch_ticks(df: DataFrame, has_fcs: bool = False):
    """31-bit ticks at the tail: the low byte carries seven of them. Adds ``ticks``."""
    f = read_tail_be(F.col("data"), 8 if has_fcs else 4, 4)
    high = F.call_function("shiftright", f.bitwiseAND(0xFFFFFF00), F.lit(1))
    return df.withColumn("ticks", high.bitwiseOR(f.bitwiseAND(0x7F)))
