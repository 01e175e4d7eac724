"""Capture-filter expressions compiled to Column predicates.

An expression is parsed to a tree first, then compiled for Ethernet frames in ``data``. A predicate is true, false, or NULL: a read
beyond the captured bytes (or a division by zero) ends the evaluation, and the packet is rejected whatever stands
around it. ``and`` and ``or`` have equal precedence and group to the left; a side is only looked at if the one before it leaves the result open. A
bare value repeats the last qualifiers (``port 80 or 443``). ``vlan``, ``mpls`` and ``pppoes`` move the offsets of everything
after them in the text. Arithmetic is on unsigned 32-bit numbers. An empty expression accepts everything.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import U32, ip_number, mac_hex, read_be


class FilterError(ValueError):
    """The expression is malformed."""


class UnsupportedFilter(FilterError):
    """Well-formed, but not for Ethernet or not supported."""


# Protocol numbers, Ethernet types and named offsets of the filter language.
IP_PROTOS = {"icmp": 1, "igmp": 2, "igrp": 9, "tcp": 6, "udp": 17, "sctp": 132, "pim": 103, "vrrp": 112, "carp": 112, "ah": 51, "esp": 50, "icmp6": 58}
BOTH_FAMILIES = {"tcp", "udp", "sctp", "pim", "ah", "esp"}
ETHER_TYPES = {"ip": 0x0800, "ip6": 0x86DD, "arp": 0x0806, "rarp": 0x8035}
CONSTANTS = {
    "icmptype": 0, "icmpcode": 1, "tcpflags": 13,
    "icmp-echoreply": 0, "icmp-unreach": 3, "icmp-sourcequench": 4, "icmp-redirect": 5, "icmp-echo": 8, "icmp-routeradvert": 9, "icmp-routersolicit": 10,
    "icmp-timxceed": 11, "icmp-paramprob": 12, "icmp-tstamp": 13, "icmp-tstampreply": 14, "icmp-ireq": 15, "icmp-ireqreply": 16, "icmp-maskreq": 17, "icmp-maskreply": 18,
    "tcp-fin": 1, "tcp-syn": 2, "tcp-rst": 4, "tcp-push": 8, "tcp-ack": 16, "tcp-urg": 32,
}
SERVICES = {"ftp": 21, "ssh": 22, "telnet": 23, "smtp": 25, "domain": 53, "http": 80, "ntp": 123, "snmp": 161, "https": 443}
FOREIGN = set("wlan fddi tr atm lane mtp2 mtp3 sio opc dpc sls isis iso clnp esis decnet ipx netbeui stp lat moprc mopdl aarp atalk inbound outbound ifname on rset ruleset reason action gateway ".split())

_TOKEN = re.compile(
    r"\s*(?:(?P<ip6>[0-9a-fA-F:]*::[0-9a-fA-F:]*(?:(?<=:)\d+(?:\.\d+){3})?|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}\b)|(?P<mac>[0-9a-fA-F]{1,2}(?:[:-][0-9a-fA-F]{1,2}){5}\b)|(?P<addr>\d+(?:\.\d+){1,3})|(?P<num>0[xX][0-9a-fA-F]+|\d+\b)"
    r"|(?P<word>[a-zA-Z][\w]*(?:-[a-zA-Z][\w]*)*)|(?P<op>&&|\|\||<<|>>|>=|<=|!=|==|[-+*/&|<>=!()\[\]:]))"
)


def as_number(text: str) -> int:
    """Decimal, hexadecimal after ``0x``, octal after ``0``."""
    try:
        return int(text, 8 if re.fullmatch(r"0\d+", text) else 0)
    except ValueError as e:
        raise FilterError(f"not a number: {text!r}") from e


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise FilterError(f"can't read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


@dataclass
class Qualifiers:
    proto: str | None = None
    way: str = "either"
    kind: str | None = None


@dataclass
class Parser:
    """Recursive descent; the tree is made of tuples."""

    todo: list[tuple[str, str]]
    at: int = 0
    last: Qualifiers = field(default_factory=Qualifiers)

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.todo[i] if i < len(self.todo) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end" or (text is not None and t[1] != text):
            raise FilterError(f"expected {text or 'more'}, found {t[1] or 'the end'}")
        self.at += 1
        return t

    def skip(self, *texts: str) -> bool:
        if self.peek()[1] in texts and self.peek()[0] in ("word", "op"):
            self.at += 1
            return True
        return False

    def whole(self) -> tuple:
        if not self.todo:
            return ("all",)
        tree = self.expression()
        if self.peek()[0] != "end":
            raise FilterError(f"can't go on at {self.peek()[1]!r}")
        return tree

    def expression(self) -> tuple:
        left = self.term()
        while True:
            if self.skip("and", "&&"):
                left = ("and", left, self.term(bare=True))
            elif self.skip("or", "||"):
                left = ("or", left, self.term(bare=True))
            else:
                return left

    def term(self, bare: bool = False) -> tuple:
        if self.skip("not", "!"):
            return ("not", self.term(bare))
        if self.peek()[1] == "(" and not self.is_arithmetic():
            self.take("(")
            inner = self.expression()
            self.take(")")
            return inner
        if self.is_arithmetic():
            return self.relation()
        return self.primitive(bare)

    def is_arithmetic(self) -> bool:
        """Whether a relation starts here: an expression that a comparison follows before any other word."""
        save, depth = self.at, 0
        try:
            k, t = self.peek()
            if k == "num" or t in ("-", "len", "(") or (k == "word" and (self.peek(1)[1] == "[" or t in CONSTANTS)):
                i = self.at
                while i < len(self.todo):
                    kind, text = self.todo[i]
                    if text in ("(", "["):
                        depth += 1
                    elif text in (")", "]"):
                        depth -= 1
                        if depth < 0:
                            return False
                    elif depth == 0 and text in (">", ">=", "<", "<=", "=", "==", "!="):
                        return True
                    elif kind == "word" and text in ("and", "or", "not") or text in ("&&", "||", "!"):
                        return False
                    elif kind in ("mac", "addr", "ip6"):
                        return False
                    i += 1
            return False
        finally:
            self.at = save

    def relation(self) -> tuple:
        left = self.arith()
        op = self.take()[1]
        if op not in (">", ">=", "<", "<=", "=", "==", "!="):
            raise FilterError(f"expected a comparison, found {op!r}")
        return ("rel", "=" if op == "==" else op, left, self.arith())

    LEVELS = (("|",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/"))

    def arith(self, level: int = 0) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.arith(level + 1)
        while self.peek()[1] in self.LEVELS[level] and self.peek()[0] == "op":
            op = self.take()[1]
            left = ("arith", op, left, self.arith(level + 1))
        return left

    def unary(self) -> tuple:
        kind, text = self.take()
        if text == "-":
            return ("neg", self.unary())
        if text == "(":
            inner = self.arith()
            self.take(")")
            return inner
        if kind == "num":
            return ("num", as_number(text))
        if text == "len":
            return ("len",)
        if text in CONSTANTS:
            return ("num", CONSTANTS[text])
        if kind == "word" and self.peek()[1] == "[":
            self.take("[")
            index, size = self.arith(), 1
            if self.skip(":"):
                size = as_number(self.take()[1])
                if size not in (1, 2, 4):
                    raise FilterError("a load is of 1, 2 or 4 bytes")
            self.take("]")
            return ("load", text, index, size)
        raise FilterError(f"can't compute with {text!r}")

    def primitive(self, bare: bool) -> tuple:
        kind, text = self.peek()
        if kind in ("num", "addr", "mac", "ip6"):
            if not bare or self.last.kind is None:
                if kind == "num" and self.last.kind is None:
                    raise FilterError(f"{text} has no qualifier")
                return self.value(Qualifiers(self.last.proto, self.last.way, self.last.kind or "host"))
            return self.value(self.last)
        if text in ("less", "greater"):
            self.take()
            return ("rel", "<=" if text == "less" else ">=", ("len",), ("num", as_number(self.take()[1])))
        if text == "byte":
            self.take()
            index, op, value = as_number(self.take()[1]), self.take()[1], as_number(self.take()[1])
            if op not in ("=", "<", ">", "&", "|"):
                raise FilterError(f"byte has no {op!r}")
            return ("byte", index, op, value)
        if text in ("vlan", "mpls", "pppoed", "pppoes"):
            self.take()
            number = as_number(self.take()[1]) if self.peek()[0] == "num" and text != "pppoed" else None
            return (text, number)
        if text in FOREIGN:
            raise UnsupportedFilter(f"{text} isn't supported on Ethernet")
        if text in ("broadcast", "multicast"):
            self.take()
            return (text, "ether")
        q = Qualifiers()
        if text in ("ether", "link") or text in ETHER_TYPES or text in IP_PROTOS:
            q.proto = "ether" if text == "link" else text
            self.take()
            if self.peek()[1] in ("broadcast", "multicast"):
                return (self.take()[1], q.proto)
        if self.peek()[1] in FOREIGN:
            raise UnsupportedFilter(f"{self.peek()[1]} isn't supported")
        if self.peek()[1] in ("src", "dst"):
            q.way = self.take()[1]
            if self.peek()[1] in ("or", "and") and self.peek(1)[1] in ("src", "dst") and self.peek(1)[1] != q.way:
                q.way = "either" if self.take()[1] == "or" else "both"
                self.take()
        if self.peek()[1] in ("host", "net", "port", "portrange", "proto", "protochain"):
            q.kind = self.take()[1]
        if q.kind is None and self.peek()[0] not in ("num", "addr", "mac", "ip6"):
            if q.proto is None or q.proto == "ether" or q.way != "either":
                raise FilterError(f"can't go on at {self.peek()[1] or 'the end'!r}")
            return ("proto", q.proto)
        if q.kind is None:
            q.kind = "host"
        self.last = q
        return self.value(q)

    def value(self, q: Qualifiers) -> tuple:
        kind, text = self.take()
        if kind == "ip6" and q.kind in ("host", "net"):
            return self.address6(q, text)
        if q.kind == "host":
            if kind == "mac":
                if q.proto not in (None, "ether"):
                    raise FilterError(f"{q.proto} has no such address")
                return ("mac", q.way, mac_hex(text))
            if q.proto == "ether":
                raise FilterError("ether host wants a MAC address")
            if kind != "addr":
                raise UnsupportedFilter(f"names aren't looked up: {text!r}")
            if text.count(".") < 3:
                return self.net(q, text)
            return ("addr", q.proto, q.way, ip_number(text), U32)
        if q.kind == "net":
            if kind not in ("addr", "num"):
                raise UnsupportedFilter(f"names aren't looked up: {text!r}")
            return self.net(q, text)
        if q.kind in ("port", "portrange"):
            low = self.port(kind, text)
            high = low
            if q.kind == "portrange":
                if self.skip("-"):
                    high = self.port(*self.take())
                low, high = min(low, high), max(low, high)
            return ("port", q.proto, q.way, low, high)
        if q.kind in ("proto", "protochain"):
            if q.way != "either":
                raise FilterError(f"direction applied to {q.kind!r}")
            number = as_number(text) if kind == "num" else IP_PROTOS.get(text, ETHER_TYPES.get(text))
            if number is None:
                raise FilterError(f"unknown protocol {text!r}")
            return ("number" if q.kind == "proto" else "chain", q.proto, number)
        raise FilterError(f"unknown qualifier {q.kind!r}")

    def net(self, q: Qualifiers, text: str) -> tuple:
        parts = [int(x) for x in text.split(".")]
        value = sum(x << (24 - 8 * i) for i, x in enumerate(parts))
        mask = U32 << (32 - 8 * len(parts)) & U32
        if self.skip("/"):
            bits = as_number(self.take()[1])
            if bits > 32:
                raise FilterError("mask length must be at most 32")
            mask = U32 << (32 - bits) & U32 if bits else 0
        elif self.skip("mask"):
            mask = ip_number(self.take()[1])
        if value & ~mask & U32:
            raise FilterError(f"non-network bits set in {text!r}")
        return ("addr", q.proto, q.way, value, mask)

    def address6(self, q: Qualifiers, text: str) -> tuple:
        try:
            value = int(ipaddress.IPv6Address(text))
        except ValueError as e:
            raise FilterError(f"no IPv6 address: {text!r}") from e
        if q.proto not in (None, "ip6"):
            raise FilterError(f"'{q.proto}' modifier applied to an IPv6 address")
        bits = as_number(self.take()[1]) if self.skip("/") else 128
        if bits > 128 or (bits != 128 and q.kind != "net"):
            raise FilterError(f"invalid mask length: {text}/{bits}")
        mask = (1 << 128) - (1 << (128 - bits))
        if value & ~mask:
            raise FilterError(f"non-network bits set in {text!r}")
        return ("addr6", q.way, value, mask)

    def port(self, kind: str, text: str) -> int:
        if kind == "num":
            n = as_number(text)
        elif text in SERVICES:
            n = SERVICES[text]
        else:
            raise UnsupportedFilter(f"unknown service {text!r}")
        if n > 65535:
            raise FilterError(f"no such port: {n}")
        return n


def parse(text: str) -> tuple:
    return Parser(tokens(text)).whole()


@dataclass
class Test:
    """A test as two non-null Columns: whether it holds, and whether it ends the evaluation. Both are plain boolean logic, so a term isn't repeated where it is used."""

    holds: Column
    ends: Column | None = None

    def __invert__(self) -> Test:
        return Test(~self.holds if self.ends is None else ~self.holds & ~self.ends, self.ends)


def both(*terms: Test) -> Test:
    """All of the terms, from left to right."""
    out = terms[-1]
    for t in reversed(terms[:-1]):
        after = None if out.ends is None else t.holds & out.ends
        out = Test(t.holds & out.holds, after if t.ends is None else t.ends if after is None else t.ends | after)
    return out


def any_of(*terms: Test) -> Test:
    """Any of the terms, from left to right."""
    out = terms[-1]
    for t in reversed(terms[:-1]):
        after = None if out.ends is None else ~t.holds & out.ends
        holds = t.holds | (out.holds if t.ends is None else ~t.ends & out.holds)
        out = Test(holds, after if t.ends is None else t.ends if after is None else t.ends | after)
    return out


def of(test: Column) -> Test:
    """A comparison that is NULL where a value can't be read."""
    return Test(F.coalesce(test, F.lit(False)), test.isNull())


class Compiler:
    def __init__(self, data: Column, length: Column):
        self.data, self.length = data, length
        self.type_at, self.net_at, self.labels, self.ppp = 12, 14, 0, False

    def load(self, off, size: int) -> Column:
        return read_be(self.data, off, size)

    def within(self, off, size: int, low: int, high: int) -> Test:
        """Whether the number at ``off`` is from ``low`` to ``high``: bytes compare like unsigned big-endian numbers, so none is made of them."""
        at = off if isinstance(off, Column) else F.lit(off)
        part = F.substring(self.data, at + 1, F.lit(size))
        a, z = (F.lit(bytearray(n.to_bytes(size, "big"))) for n in (low, high))
        return of(F.when((at >= 0) & (F.length(self.data) >= at + size), part == a if low == high else part.between(a, z)))

    def same(self, off, size: int, value: int) -> Test:
        if not 0 <= value < 1 << 8 * size:
            return of(self.load(off, size) == value)
        return self.within(off, size, value, value)

    def masked(self, off, size: int, value: int, mask: int) -> Test:
        """Whether the bits of ``mask`` are those of ``value``."""
        low_bits = (1 << 8 * size) - 1 - mask
        if low_bits & (low_bits + 1) == 0:  # a prefix
            return self.within(off, size, value, value | low_bits)
        return of(self.load(off, size).bitwiseAND(mask) == value)

    def compile(self, tree: tuple) -> Test:
        kind = tree[0]
        if kind in ("and", "or"):
            chain = []
            while tree[0] == kind:  # a chain of one operator is one CASE
                chain.append(tree[2])
                tree = tree[1]
            terms = [self.compile(t) for t in [tree, *reversed(chain)]]
            return both(*terms) if kind == "and" else any_of(*terms)
        return getattr(self, "on_" + kind)(*tree[1:])

    def on_all(self) -> Test:
        return Test(F.lit(True))

    def on_not(self, inner) -> Test:
        return ~self.compile(inner)

    # link layer

    def ether_type(self, value: int) -> Test:
        if self.labels:
            if value not in (0x0800, 0x86DD):
                raise FilterError("only IP is looked for under MPLS")
            bottom = of(self.load(self.net_at - 2, 1).bitwiseAND(1) == 1)
            return both(bottom, self.masked(self.net_at, 1, 0x40 if value == 0x0800 else 0x60, 0xF0))
        if self.ppp:
            value = {0x0800: 0x21, 0x86DD: 0x57}.get(value, value)
        return self.same(self.type_at, 2, value)

    def on_vlan(self, number) -> Test:
        if self.labels:
            raise FilterError("no VLAN match after MPLS")
        tag = of(self.load(self.type_at, 2).isin(0x8100, 0x9100))
        here = tag if number is None else both(tag, of(self.load(self.net_at, 2).bitwiseAND(0x0FFF) == number))
        self.type_at += 4
        self.net_at += 4
        return here

    def on_mpls(self, number) -> Test:
        if self.labels:
            here = of(self.load(self.net_at - 2, 1).bitwiseAND(1) == 0)  # not the last label yet
        else:
            here = self.same(self.type_at, 2, 0x8847)
        if number is not None:
            here = both(here, of(self.load(self.net_at, 4).bitwiseAND(0xFFFFF000) == number << 12))
        self.labels += 1
        self.net_at += 4
        return here

    def on_pppoed(self, number) -> Test:
        return self.same(self.type_at, 2, 0x8863)

    def on_pppoes(self, number) -> Test:
        here = self.same(self.type_at, 2, 0x8864)
        if number is not None:
            here = both(here, of(self.load(self.net_at + 2, 2) == number))
        self.type_at, self.net_at, self.ppp = self.net_at + 6, self.net_at + 8, True
        return here

    def on_mac(self, way: str, digits: str) -> Test:
        def same(off):
            return self.same(off, 6, int(digits, 16))

        return self.directed(way, same(6), same(0))

    def directed(self, way: str, src: Test, dst: Test) -> Test:
        return {"src": src, "dst": dst, "either": any_of(src, dst), "both": both(src, dst)}[way]

    def on_broadcast(self, proto: str) -> Test:
        if proto != "ether":
            raise FilterError("the netmask isn't known, so 'ip broadcast' is not supported")
        return self.same(0, 6, (1 << 48) - 1)

    def on_multicast(self, proto: str) -> Test:
        if proto == "ether":
            return of(self.load(0, 1).bitwiseAND(1) != 0)
        if proto == "ip":
            return both(self.ether_type(0x0800), of(self.load(self.net_at + 16, 1) >= 224))
        if proto == "ip6":
            return both(self.ether_type(0x86DD), of(self.load(self.net_at + 24, 1) == 255))
        raise FilterError(f"{proto} has no multicast")

    def on_byte(self, index: int, op: str, value: int) -> Test:
        if op in ("&", "|"):  # no load takes place: the test is of the constant with an accumulator of zero
            return Test(F.lit((value if op == "|" else 0) != 0))
        got = self.load(index, 1)
        return of(got == value if op == "=" else got < value if op == "<" else got > value)

    # network layer

    def ip4(self, *more: Test) -> Test:
        return both(self.ether_type(0x0800), *more)

    def ip6(self, *more: Test) -> Test:
        return both(self.ether_type(0x86DD), *more)

    def proto4(self, number: int) -> Test:
        return self.same(self.net_at + 9, 1, number)

    def proto6(self, number: int) -> Test:
        return self.same(self.net_at + 6, 1, number)

    def proto6_any(self, number: int) -> Test:
        """The next header, or the one after a fragment header."""
        return any_of(self.proto6(number), both(self.proto6(44), self.same(self.net_at + 40, 1, number)))

    def on_proto(self, name: str) -> Test:
        if name in ETHER_TYPES:
            return self.ether_type(ETHER_TYPES[name])
        if name == "icmp6":
            return self.ip6(self.proto6_any(58))
        if name in BOTH_FAMILIES:
            return any_of(self.ip4(self.proto4(IP_PROTOS[name])), self.ip6(self.proto6_any(IP_PROTOS[name])))
        return self.ip4(self.proto4(IP_PROTOS[name]))

    def on_number(self, proto: str | None, number: int) -> Test:
        if proto == "ether":
            return self.ether_type(number)
        if proto == "ip":
            return self.ip4(self.proto4(number))
        if proto == "ip6":
            return self.ip6(self.proto6_any(number))
        if proto is None:
            return any_of(self.ip4(self.proto4(number)), self.ip6(self.proto6_any(number)))
        raise FilterError(f"'{proto} proto' is bogus")

    def on_chain(self, proto: str | None, number: int) -> Test:
        """A protocol anywhere in the chain of headers: authentication headers, and for IPv6 hop-by-hop, routing, fragment and destination options."""
        if proto not in (None, "ip", "ip6"):
            raise FilterError(f"bad protocol of 'protochain': {proto}")
        four = self.ip4(self.chain(self.load(self.net_at + 9, 1), self.transport(), number, False))
        six = self.ip6(self.chain(self.load(self.net_at + 6, 1), F.lit(self.net_at + 40), number, True))
        return four if proto == "ip" else six if proto == "ip6" else any_of(four, six)

    def chain(self, first: Column, start: Column, number: int, options: bool) -> Test:
        going, found, lost, short = range(4)

        def step(acc: Column, _: Column) -> Column:
            kind, at, state = acc["kind"], acc["at"], acc["state"]
            after, size = self.load(at, 1), self.load(at + 1, 1)
            auth, option = kind == 51, kind.isin(0, 43, 44, 60) if options else F.lit(False)
            new = F.when(kind == number, found).when(kind == 59, lost).when(~(auth | option), lost).when(after.isNull() | size.isNull(), short).otherwise(going)
            now = F.when(state == going, new).otherwise(state)
            move = now == going
            return F.struct(
                F.when(move, after).otherwise(kind).alias("kind"),
                F.when(move, at + F.when(auth, (size + 2) * 4).otherwise((size + 1) * 8)).otherwise(at).cast("long").alias("at"),
                now.cast("int").alias("state"),
            )

        begin = F.struct(first.cast("long").alias("kind"), start.cast("long").alias("at"), F.when(first.isNull() | start.isNull(), short).otherwise(going).cast("int").alias("state"))
        headers = F.sequence(F.lit(1), F.greatest(F.lit(1), F.call_function("div", F.length(self.data), F.lit(8)).cast("int")))
        end = F.aggregate(headers, begin, step, lambda acc: acc["state"])
        return of(F.when(end != short, end == found))

    def on_addr(self, proto: str | None, way: str, value: int, mask: int) -> Test:
        def at(ether_type: int, src: int, dst: int) -> Test:
            return both(self.ether_type(ether_type), self.directed(way, *[self.masked(self.net_at + o, 4, value, mask) for o in (src, dst)]))

        ways = {"ip": (0x0800, 12, 16), "arp": (0x0806, 14, 24), "rarp": (0x8035, 14, 24)}
        if proto is None:
            return any_of(*[at(*ways[p]) for p in (("ip",) if self.labels else ("ip", "arp", "rarp"))])
        if proto not in ways:
            raise FilterError(f"'{proto}' modifier applied to an address")
        return at(*ways[proto])

    def on_addr6(self, way: str, value: int, mask: int) -> Test:
        def same(off: int) -> Test:
            words = [(off + 4 * k, value >> 96 - 32 * k & U32, mask >> 96 - 32 * k & U32) for k in range(4)]
            return both(*[self.masked(self.net_at + o, 4, v, m) for o, v, m in words])

        return self.ip6(self.directed(way, same(8), same(24)))

    # transport layer

    def transport(self) -> Column:
        return self.net_at + self.load(self.net_at, 1).bitwiseAND(0x0F) * 4

    def first_fragment(self) -> Test:
        return of(self.load(self.net_at + 6, 2).bitwiseAND(0x1FFF) == 0)

    def on_port(self, proto: str | None, way: str, low: int, high: int) -> Test:
        if proto not in (None, "tcp", "udp", "sctp"):
            raise FilterError(f"illegal qualifier of 'port': {proto}")
        numbers = [IP_PROTOS[p] for p in ([proto] if proto else ["tcp", "udp", "sctp"])]

        def there(at) -> Test:
            return self.directed(way, *[self.within(at + o, 2, low, high) for o in (0, 2)])

        six = self.ip6(any_of(*[self.proto6(n) for n in numbers]), there(self.net_at + 40))
        four = self.ip4(any_of(*[self.proto4(n) for n in numbers]), self.first_fragment(), there(self.transport()))
        return any_of(six, four)

    # arithmetic

    def on_rel(self, op: str, left: tuple, right: tuple) -> Test:
        guards: list[Test] = []
        a, b = self.arith(left, guards), self.arith(right, guards)
        test = {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
        return both(*guards, of(test))

    def arith(self, tree: tuple, guards: list[Test]) -> Column:
        kind = tree[0]
        if kind == "num":
            return F.lit(tree[1] & U32).cast("long")
        if kind == "len":
            return self.length.cast("long")
        if kind == "neg":
            return (-self.arith(tree[1], guards)).bitwiseAND(U32)
        if kind == "load":
            return self.on_load(*tree[1:], guards)
        _, op, left, right = tree
        if op == "/" and right == ("num", 0):
            raise FilterError("division by zero")
        a, b = self.arith(left, guards), self.arith(right, guards)
        if op == "+":
            return (a + b).bitwiseAND(U32)
        if op == "-":
            return (a - b).bitwiseAND(U32)
        if op == "*":  # in halves: the product of two 32-bit numbers doesn't fit a long
            high = F.call_function("shiftrightunsigned", a, F.lit(16))
            return ((high * b).bitwiseAND(0xFFFF) * 65536 + a.bitwiseAND(0xFFFF) * b).bitwiseAND(U32)
        if op == "/":
            return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))
        if op == "&":
            return a.bitwiseAND(b)
        if op == "|":
            return a.bitwiseOR(b)
        moved = F.call_function("shiftleft" if op == "<<" else "shiftrightunsigned", a, b.cast("int"))
        return F.when(b < 32, moved.bitwiseAND(U32))

    def on_load(self, name: str, index: tuple, size: int, guards: list[Test]) -> Column:
        at = self.arith(index, guards)
        if name in ("ether", "link"):
            return self.load(at, size)
        if name in ("ip", "arp", "rarp", "ip6"):
            guards.append(self.ether_type(ETHER_TYPES[name]))
            return self.load(at + self.net_at, size)
        if name in IP_PROTOS and name != "icmp6":
            guards.append(self.ip4(self.proto4(IP_PROTOS[name])))
            guards.append(self.first_fragment())
            return self.load(at + self.transport(), size)
        if name == "icmp6":
            guards.append(self.ip6(self.proto6_any(58)))
            return self.load(at + self.net_at + 40, size)
        raise UnsupportedFilter(f"no loads from {name!r}")


def predicate(text: str, data: Column | None = None, length: Column | None = None) -> Column:
    """A non-null boolean Column: whether a packet passes."""
    data = F.col("data") if data is None else data
    length = F.col("frame_len") if length is None else length
    return Compiler(data, length).compile(parse(text)).holds


def split(df: DataFrame, text: str) -> dict[str, DataFrame]:
    """``""``: packets that pass; ``not_matched``: the others."""
    p = predicate(text)
    return {"": df.where(p), "not_matched": df.where(~p)}
