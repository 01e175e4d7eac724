"""Composed pipelines: capture, replay, balance and merge, and the ``key=value`` arguments that set them up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import balance as balancing
from .operators import edit, files, select, timing
from .plans.graph import REGISTRY, parse_number, parse_spec


def parse_args(args: list[str], repeatable: tuple[str, ...] = ("filter", "streams")) -> dict[str, str]:
    """``key=value`` words; repeated keys of ``repeatable`` are joined by ``;``, others must not repeat."""
    out: dict[str, str] = {}
    for a in args:
        key, eq, value = a.partition("=")
        if not eq:
            raise ValueError(f"expected key=value, found {a!r}")
        if key in out:
            if key not in repeatable:
                raise ValueError(f"{key} is given twice")
            value = f"{out[key]};{value}"
        out[key] = value
    return out


def read_words(path: str) -> list[str]:
    """Words of a settings file, one a line; what follows ``#`` isn't read."""
    with open(path, encoding="utf-8") as f:
        return [w for w in (line.split("#")[0].strip() for line in f) if w]


def parse_command(words: list[str], known: set[str], repeatable: tuple[str, ...] = ("filter", "streams"), flags: tuple[str, ...] = ()) -> list[dict]:
    """A command's words as sections of settings, one for each source.

    ``key=value`` with a known key is a setting, a flag alone sets it, ``type:key=value;key=value`` adds a node to ``extensions``, ``config_file=PATH`` stands for the words of
    that file, and any other ``NAME`` or ``NAME=VALUE`` begins the section of a source of that name. What stands before the first source holds for all. A repeatable key that
    repeats in a section is joined by ``;``; else the last one holds."""
    common: dict = {"extensions": []}
    sections: list[dict] = []
    own: set[str] = set()  # keys set in this section

    def take(words: list[str], depth: int) -> None:
        if depth > 16:
            raise ValueError("config files name one another")
        for word in words:
            now = sections[-1] if sections else common
            eq, colon = word.find("="), word.find(":")
            if eq >= 0 and (colon < 0 or eq < colon):
                key, value = word.split("=", 1)
                if key == "config_file":
                    take(read_words(value), depth + 1)
                    continue
                if key in known:
                    now[key] = f"{now[key]};{value}" if key in repeatable and key in own else value
                    own.add(key)
                    continue
            elif colon >= 0:
                name, rest = word.split(":", 1)
                args = dict(part.split("=", 1) if "=" in part else (part, "") for part in rest.split(";") if part)
                now["extensions"] = [*now["extensions"], (name, args)]
                continue
            elif word in flags:
                now[word] = True
                continue
            else:
                key, value = word, None
            own.clear()
            sections.append(common | {"source": key, "value": value})

    take(words, 0)
    return sections or [common]


def _extended(df: DataFrame, extensions: list[str | tuple[str, dict]]) -> DataFrame:
    for spec in extensions:
        name, args = parse_spec(spec) if isinstance(spec, str) else spec
        made = REGISTRY[name][0](df, **args)
        df = made[""] if isinstance(made, dict) else made
    return df


def capture(
    df: DataFrame,
    streams: str | None = None,
    filter: str | None = None,
    discard: list[str] | None = None,
    extensions: list[str] | None = None,
    packet_count: int | None = None,
    snap: int | None = None,
    rotate_seconds: int | None = None,
    strip_vlan: bool = False,
) -> DataFrame:
    """Stream match, error flags, filter, extensions (last given first), packet count, snap, and the file each packet goes to."""
    if streams:
        df = select.stream_filter(df, streams)
    if discard:
        df = select.discard(df, discard)
    if strip_vlan:
        df = edit.strip_vlan(df)
    if filter:
        df = df.where(select.predicate(filter))
    df = _extended(df, list(reversed(extensions or [])))
    if packet_count is not None:
        df = select.pass_n(df, packet_count)[""]
    if snap is not None:
        df = edit.snap(df, snap)
    return files.rotate_by_time(df, rotate_seconds) if rotate_seconds else df


def replay(
    df: DataFrame,
    range: str | None = None,
    time_range: str | None = None,
    filter: str | None = None,
    repeat: int = 1,
    extensions: list[str] | None = None,
    speedup: float | None = None,
    pps: str | int | None = None,
    bw: str | int | None = None,
) -> DataFrame:
    """What would be sent, with the times at which it would be."""
    if range:
        df = select.range_filter(df, range)[""]
    if time_range:
        df = select.time_filter(df, time_range)[""]
    if filter:
        df = df.where(select.predicate(filter))
    if repeat > 1:
        df = timing.repeat(df, repeat)
    df = _extended(df, extensions or [])
    if pps is not None:
        return timing.adjust_pps(df, parse_number(pps))
    if bw is not None:
        return timing.adjust_bandwidth(df, parse_number(bw))
    return timing.pacer(timing.adjust_speedup(df, speedup or 1))


def balance(df: DataFrame, channels: int, mode: str = "rr", idle_ns: int | None = balancing.FLOW_IDLE_NS) -> DataFrame:
    if mode not in ("rr", "estimate"):
        raise ValueError(f"unknown mode {mode!r}")
    return (balancing.balance_round_robin if mode == "rr" else balancing.balance_least_load)(df, channels, idle_ns)


def merge(*inputs: DataFrame) -> DataFrame:
    return balancing.merge(*[d.withColumn("src", F.lit(i).cast("long")) for i, d in enumerate(inputs)])
