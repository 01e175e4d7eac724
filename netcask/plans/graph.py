"""Graphs of named nodes and links, lazily turned into DataFrames; node specifications ``type:key=value;key=value``; and drawings of them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import balance, edit, encap, metrics, select, stamps, timing
from .filterlang import split

Links = dict[str, DataFrame]
#: Type name to (function of the input and arguments, names of its outputs).
REGISTRY: dict[str, tuple[Callable[..., Links | DataFrame], tuple[str, ...]]] = {}


def register_node(name: str, outputs: tuple[str, ...] = ("",)):
    """Register a function (df, **args) as a node type."""

    def add(f):
        REGISTRY[name] = (f, outputs)
        return f

    return add


register_node("no_op")(lambda df: df)
register_node("filter", ("", "not_matched"))(lambda df, bpf: split(df, bpf))
register_node("range_filter", ("", "reject"))(lambda df, range: select.range_filter(df, range))
register_node("timestamp_filter", ("", "reject"))(lambda df, range, out_of_order_timestamps=0: select.time_filter(df, range, bool(int(out_of_order_timestamps))))
register_node("pass_n", ("", "the_rest"))(lambda df, n: select.pass_n(df, int(n)))
register_node("snap")(lambda df, snap: edit.snap(df, int(snap)))
register_node("strip_vlan")(lambda df, tpid=0x8100: edit.strip_vlan(df, int(str(tpid), 0)))
register_node("tap", ("", "tap"))(lambda df, bpf=None, snap=None: select.tap(df, bpf, None if snap is None else int(snap)))
register_node("repeater")(lambda df, n: timing.repeat(df, int(n)))
register_node("pacer")(lambda df: timing.pacer(df))
register_node("tracer")(lambda df: timing.tracer(df))
register_node("reflect")(lambda df: edit.reflect(df))
register_node("rr_spreader")(lambda df, n: balance.spread(df, int(n)))


register_node("merge_sorter")(lambda df: balance.merge(df))
register_node("rr_gather")(lambda df, n: balance.gather(df, int(n)))
register_node("flow_balancer")(lambda df, n, mode="rr": (balance.balance_least_load if mode == "estimate" else balance.balance_round_robin)(df, int(n)))
register_node("token_bucket_shaper")(lambda df, max_pps=None, max_bps=None, overhead=0: timing.token_bucket(df, max_pps and parse_number(max_pps), max_bps and parse_number(max_bps), int(overhead)))
register_node("delay_line")(lambda df, num_lines=1, usec_min=0, usec_max=0: timing.delay_line(df, int(num_lines), float(usec_min), float(usec_max)))
register_node("batch_limiter")(lambda df, max_packets: timing.batch_ids(df, int(max_packets)))
register_node("rt_pacer")(lambda df, command, n=None: timing.paced(df, command, n=None if n is None else int(n)))
register_node("vss")(lambda df: stamps.vss(df))
register_node("cpacket_ts")(lambda df, has_fcs=1, keep_cpacket_footer=0, is_metamako=0: stamps.footer_stamp(df, bool(int(has_fcs)), not int(keep_cpacket_footer), extensions=bool(int(is_metamako))))
register_node("cpacket_encap")(lambda df, version=0, device_id=0, port=0: stamps.footer_encap(df, int(version), int(device_id), int(port)))
register_node("arista_ts", ("", "no_timestamp", "lldp"))(lambda df, ts_format=None, switch_model="7280": stamps.switch_stamps(df, switch_model, ts_format))
register_node("strip_stamp")(lambda df: stamps.switch48(df))
register_node("header_editor")(lambda df, **rules: edit.edit_headers(df, **rules))
register_node("append_ts")(lambda df: edit.append_timestamp(df))
register_node("drop_n", ("", "drop"))(lambda df, n: select.drop_every(df, int(n)))
register_node("dropper", ("", "drop"))(lambda df, p, seed=0: select.drop_at_random(df, float(p), int(seed)))
register_node("scatter")(lambda df, n, seed=0: encap.scatter(df, int(n), int(seed)))
register_node("mode1_encap")(lambda df, **args: encap.mode1_encap(df, **args))
register_node("discard")(lambda df, mask: select.discard(df, mask.split(",")))
register_node("rate_monitor")(lambda df, period=0.1, alpha=0.5: metrics.smoothed_rates(df, int(float(period) * 1e9), float(alpha)))
register_node("check_cap_len")(lambda df: metrics.length_check(df))
register_node("measure_ipg")(lambda df, skip=0: metrics.mean_gap(df, int(skip)))


@register_node("ts_adjust")
def _ts_adjust(df: DataFrame, speedup=None, pps=None, bw=None, start_at_ns=None, offset_ns=0) -> DataFrame:
    start, offset = None if start_at_ns is None else int(start_at_ns), int(offset_ns)
    if pps is not None:
        return timing.adjust_pps(df, parse_number(pps), start, offset)
    if bw is not None:
        return timing.adjust_bandwidth(df, parse_number(bw), start, offset)
    return timing.adjust_speedup(df, float(speedup or 1), start, offset)


def parse_number(text: str | int | float) -> int:
    """Numbers with an optional factor k, M or G."""
    m = re.fullmatch(r"\s*([\d.]+)\s*([kMG]?)\s*", str(text))
    if not m:
        raise ValueError(f"not a number: {text!r}")
    return int(float(m[1]) * {"": 1, "k": 1e3, "M": 1e6, "G": 1e9}[m[2]])


def parse_size(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(B|[kMG]i?B)?\s*", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * {None: 1, "B": 1, "kB": 10**3, "MB": 10**6, "GB": 10**9, "kiB": 2**10, "MiB": 2**20, "GiB": 2**30}[m[2]]) if m[2] != "KiB" else int(float(m[1]) * 1024)


def parse_spec(spec: str) -> tuple[str, dict[str, str]]:
    """``type:key=value;key=value``"""
    name, _, rest = spec.partition(":")
    args = {}
    for part in filter(None, (p.strip() for p in rest.split(";"))):
        key, eq, value = part.partition("=")
        if not eq:
            raise ValueError(f"no value for {key!r} in {spec!r}")
        args[key.strip()] = value.strip()
    return name.strip(), args


@dataclass
class Node:
    graph: Graph
    name: str
    type: str
    args: dict
    source: DataFrame | None = None
    links: dict[str, list[Node]] = field(default_factory=dict)

    def connect(self, *where) -> Node:
        """``connect(to)``, ``connect("link", to)``; returns the node connected to."""
        link, to = where if len(where) == 2 else ("", where[0])
        outputs = REGISTRY[self.type][1] if self.source is None else ("",)
        if link not in outputs:
            raise ValueError(f"{self.type} has no link {link!r}")
        self.links.setdefault(link, []).append(to)
        return to


class Graph:
    """Nodes by name. Nothing runs until an output is used."""

    def __init__(self):
        self.nodes: dict[str, Node] = {}

    def _add(self, node: Node) -> Node:
        if node.name in self.nodes:
            raise ValueError(f"two nodes named {node.name!r}")
        self.nodes[node.name] = node
        return node

    def source(self, name: str, df: DataFrame) -> Node:
        return self._add(Node(self, name, "source", {}, df))

    def node(self, spec: str, name: str | None = None, **args) -> Node:
        kind, more = parse_spec(spec)
        if kind not in REGISTRY:
            raise ValueError(f"unknown node type {kind!r}")
        return self._add(Node(self, name or f"{kind}{len(self.nodes)}", kind, more | args))

    def order(self) -> list[Node]:
        """Topological; a loop is an error."""
        out: list[Node] = []
        state: dict[str, int] = {}

        def visit(n: Node) -> None:
            if state.get(n.name) == 1:
                raise ValueError(f"a loop through {n.name!r}")
            if n.name not in state:
                state[n.name] = 1
                for tos in n.links.values():
                    for t in tos:
                        visit(t)
                state[n.name] = 2
                out.append(n)

        for n in self.nodes.values():
            visit(n)
        return out[::-1]

    def build(self) -> dict[tuple[str, str], DataFrame]:
        """(node, link) to DataFrame, for every node that can be reached. Several links into a node are a union."""
        inputs: dict[str, list[DataFrame]] = {}
        out: dict[tuple[str, str], DataFrame] = {}
        for n in self.order():
            if n.source is not None:
                made = n.source
            elif n.name in inputs:
                made = REGISTRY[n.type][0](balance.union(*inputs[n.name]), **n.args)
            else:
                continue
            links = made if isinstance(made, dict) else {"": made}
            for link, df in links.items():
                out[n.name, link] = df
                for to in n.links.get(link, []):
                    inputs.setdefault(to.name, []).append(df)
        return out

    def stats(self) -> DataFrame:
        """(node, pkts_in, pkts_out) of every node that isn't a source, over all its inputs and links. Counts only; data isn't kept."""
        made = self.build()
        rows: list[DataFrame] = []
        for n in self.nodes.values():
            if n.source is not None:
                continue
            for m in self.nodes.values():
                for link, tos in m.links.items():
                    rows += [made[m.name, link].select(F.lit(n.name).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))] * sum(t is n for t in tos if (m.name, link) in made)
            links = REGISTRY[n.type][1]
            rows += [made[n.name, link].select(F.lit(n.name).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")) for link in links if (n.name, link) in made and (link == "" or link in n.links)]
        return balance.union(*rows).groupBy("node").agg(F.sum("i").alias("pkts_in"), F.sum("o").alias("pkts_out"))

    def find(self, what: str) -> list[Node]:
        """Nodes by name, by ``type=NAME``, or by ``ARG=VALUE``; ``*`` stands for anything."""
        key, eq, value = what.rpartition("=")
        if not eq:
            return [n for n in self.nodes.values() if fnmatchcase(n.name, what)]
        return [n for n in self.nodes.values() if fnmatchcase(str(n.type if key == "type" else n.args.get(key, "")), value) and (key == "type" or key in n.args)]

    def to_dot(self) -> str:
        rows = [f'  "{n.name}" [label="{n.name}\\n{n.type}"];' for n in self.nodes.values()]
        rows += [f'  "{n.name}" -> "{t.name}"' + (f' [label="{link}"]' if link else "") + ";" for n in self.nodes.values() for link, tos in n.links.items() for t in tos]
        return "digraph netcask {\n" + "\n".join(rows) + "\n}\n"
