"""The filter compiler against a plain interpreter of the parsed tree, on hand-made and random packets."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netcask.plans.filterlang import CONSTANTS, ETHER_TYPES, IP_PROTOS, FilterError, UnsupportedFilter, parse, predicate


class Abort(Exception):
    pass


class Machine:
    """Evaluates a tree on one packet, step by step; a short read ends it."""

    def __init__(self, data, length):
        self.d, self.n = data, length

    def run(self, tree):
        self.type_at, self.net = 12, 14
        self.moves = {}
        self.place(tree)
        try:
            return self.ev(tree)
        except Abort:
            return False

    def place(self, tree):
        """Offsets hold from where they stand in the text on, whatever is evaluated."""
        if tree[0] in ("and", "or"):
            self.place(tree[1])
            self.place(tree[2])
        elif tree[0] == "not":
            self.place(tree[1])
        else:
            self.moves[id(tree)] = (self.type_at, self.net)
            if tree[0] == "vlan":
                self.type_at += 4
                self.net += 4

    def ld(self, at, size):
        if at < 0 or at + size > len(self.d):
            raise Abort
        return int.from_bytes(self.d[at : at + size], "big")

    def ev(self, t):
        k = t[0]
        if k == "and":
            return self.ev(t[1]) and self.ev(t[2])
        if k == "or":
            return self.ev(t[1]) or self.ev(t[2])
        if k == "not":
            return not self.ev(t[1])
        if k == "all":
            return True
        self.t_at, self.n_at = self.moves[id(t)]
        return getattr(self, "e_" + k)(*t[1:])

    def et(self, v):
        return self.ld(self.t_at, 2) == v

    def e_vlan(self, number):
        return self.ld(self.t_at, 2) in (0x8100, 0x9100) and (number is None or self.ld(self.n_at, 2) & 0xFFF == number)

    def p6(self, v):
        return self.ld(self.n_at + 6, 1) == v or (self.ld(self.n_at + 6, 1) == 44 and self.ld(self.n_at + 40, 1) == v)

    def e_proto(self, name):
        if name in ETHER_TYPES:
            return self.et(ETHER_TYPES[name])
        if self.et(0x800) and self.ld(self.n_at + 9, 1) == IP_PROTOS[name]:
            return True
        return name in ("tcp", "udp", "sctp") and self.et(0x86DD) and self.p6(IP_PROTOS[name])

    def e_number(self, proto, number):
        if proto in (None, "ip") and self.et(0x800) and self.ld(self.n_at + 9, 1) == number:
            return True
        return proto in (None, "ip6") and self.et(0x86DD) and self.p6(number)

    def way(self, way, src, dst):
        if way == "src":
            return src()
        if way == "dst":
            return dst()
        return (src() or dst()) if way == "either" else (src() and dst())

    def e_addr(self, proto, way, value, mask):
        for p, et, s, d in (("ip", 0x800, 12, 16), ("arp", 0x806, 14, 24), ("rarp", 0x8035, 14, 24)):
            if proto in (None, p) and self.et(et) and self.way(way, *[lambda o=o: self.ld(self.n_at + o, 4) & mask == value for o in (s, d)]):
                return True
        return False

    def e_port(self, proto, way, low, high):
        protos = [IP_PROTOS[p] for p in ([proto] if proto else ["tcp", "udp", "sctp"])]
        if self.et(0x86DD) and self.ld(self.n_at + 6, 1) in protos:
            at = self.n_at + 40
            if self.way(way, *[lambda o=o: low <= self.ld(at + o, 2) <= high for o in (0, 2)]):
                return True
        if not (self.et(0x800) and self.ld(self.n_at + 9, 1) in protos and self.ld(self.n_at + 6, 2) & 0x1FFF == 0):
            return False
        at = self.n_at + 4 * (self.ld(self.n_at, 1) & 15)
        return self.way(way, *[lambda o=o: low <= self.ld(at + o, 2) <= high for o in (0, 2)])

    def e_mac(self, way, digits):
        def same(o):
            if len(self.d) < o + 6:
                raise Abort
            return self.d[o : o + 6].hex().upper() == digits

        return self.way(way, lambda: same(6), lambda: same(0))

    def e_rel(self, op, a, b):
        guards = []
        self.guards(a, guards)
        self.guards(b, guards)
        if not all(g() for g in guards):
            return False
        x, y = self.num(a), self.num(b)
        return {"=": x == y, "!=": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]

    def guards(self, t, out):
        if t[0] == "load":
            self.guards(t[2], out)
            if t[1] in ETHER_TYPES:
                out.append(lambda: self.et(ETHER_TYPES[t[1]]))
            elif t[1] in IP_PROTOS:
                out.append(lambda: self.et(0x800) and self.ld(self.n_at + 9, 1) == IP_PROTOS[t[1]])
                out.append(lambda: self.ld(self.n_at + 6, 2) & 0x1FFF == 0)
        elif t[0] == "arith":
            self.guards(t[2], out)
            self.guards(t[3], out)
        elif t[0] == "neg":
            self.guards(t[1], out)

    def num(self, t):
        m = 0xFFFFFFFF
        if t[0] == "num":
            return t[1] & m
        if t[0] == "len":
            return self.n
        if t[0] == "neg":
            return -self.num(t[1]) & m
        if t[0] == "load":
            base = 0 if t[1] in ("ether", "link") else self.n_at if t[1] in ETHER_TYPES else self.n_at + 4 * (self.ld(self.n_at, 1) & 15)
            return self.ld(base + self.num(t[2]), t[3])
        a, b = self.num(t[2]), self.num(t[3])
        if t[1] == "/":
            if b == 0:
                raise Abort
            return a // b
        if t[1] in ("<<", ">>"):
            if b >= 32:
                raise Abort
            return (a << b if t[1] == "<<" else a >> b) & m
        return {"+": a + b, "-": a - b, "*": a * b, "&": a & b, "|": a | b}[t[1]] & m


def frame(r):
    """A random frame: any mix of tag, IPv4, IPv6, ARP and layer 4, cut at random."""
    eth = bytes(r.choice((0, 1, 255)) for _ in range(12))
    tag = b"\x81\x00" + r.choice((5, 101)).to_bytes(2, "big") if r.random() < 0.3 else b""
    kind = r.choice((0x800, 0x800, 0x800, 0x86DD, 0x806, 0x1234))
    proto = r.choice((1, 6, 17, 132))
    ports = r.choice((53, 80, 443, 9000)).to_bytes(2, "big") + r.choice((53, 80, 443, 9000)).to_bytes(2, "big")
    if kind == 0x800:
        words = r.choice((5, 5, 6))
        frag = r.choice((0, 0, 0x2000, 7))
        body = bytes([0x40 | words, 0, 0, 60, 0, 0]) + frag.to_bytes(2, "big") + bytes([64, proto, 0, 0, 10, 0, 0, r.randrange(4), 192, 168, 1, r.randrange(4)]) + bytes(4 * (words - 5))
    elif kind == 0x86DD:
        body = bytes([0x60, 0, 0, 0, 0, 20, r.choice((proto, 44)), 64]) + bytes(32)
    else:
        body = bytes(14) + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 2])
    whole = eth + tag + kind.to_bytes(2, "big") + body + ports + bytes(r.randrange(256) for _ in range(24))
    return whole[: r.choice((len(whole), len(whole), len(whole), r.randrange(len(whole) + 1)))]


PRIMITIVES = [
    "ip", "ip6", "arp", "tcp", "udp", "icmp", "sctp", "vlan", "vlan 101", "port 80", "src port 53", "dst port 443 or 80", "udp port 53", "tcp portrange 50-90", "host 10.0.0.1", "src host 10.0.0.2",
    "dst net 192.168.1.0/30", "net 10", "src and dst port 80", "ether src 00:01:ff:00:01:ff", "ip proto 17", "less 60", "greater 70", "ip[8] = 64", "tcp[0:2] > 80", "udp[2:2] & 0xff = 53", "len - 14 >= 40",
    "ether[0] & 1 != 0", "ip[2:2] * 3 + 1 < 200", "ip[0] >> 4 = 4", "ip[70] = 0", "100 / ip[19] > 30", "ip[19] << 31 = 0", "-1 > len", "tcp[tcpflags] & tcp-syn != 0", "arp host 10.0.0.1",
]


def expressions(r):
    parts = [r.choice(PRIMITIVES) for _ in range(r.randrange(1, 5))]
    text = ""
    for i, p in enumerate(parts):
        p = f"not ({p})" if r.random() < 0.3 else p
        text = p if i == 0 else f"({text}) {r.choice(('and', 'or'))} {p}" if r.random() < 0.4 else f"{text} {r.choice(('and', 'or', '&&', '||'))} {p}"
    return text


def test_against_interpreter(spark):
    r = random.Random(11)
    packets = [(i, bytearray(f), max(len(f), r.choice((0, 80, 1500)))) for i, f in enumerate(frame(r) for _ in range(400))]
    df = spark.createDataFrame(packets, "i int, data binary, frame_len int").cache()
    texts = PRIMITIVES + [expressions(r) for _ in range(40)] + ["ip[70] = 0 or ip", "not ip[70] = 0", "vlan 101 or ip", "(vlan and ip) or ip", ""]
    for at in range(0, len(texts), 10):
        part = texts[at : at + 10]
        rows = df.select("i", *[predicate(t).alias(f"p{k}") for k, t in enumerate(part)]).collect()
        for k, t in enumerate(part):
            tree = parse(t)
            got = {row["i"]: row[f"p{k}"] for row in rows}
            want = {i: bool(Machine(bytes(d), n).run(tree)) for i, d, n in packets}
            assert got == want, t


@pytest.mark.parametrize("text", ["port", "tcp and", "port 99999", "1 +", "host 1.2.3.4.5", "ip broadcast", "net 10.0.0.1/8", "4 / 0 = 1", "ip[0:3] = 1", "80", ")", "src tcp", "ether host 1.2.3.4"])
def test_malformed(text):
    with pytest.raises(FilterError):
        predicate(text)


@pytest.mark.parametrize("text", ["wlan type mgt", "host example", "atalk", "gateway x"])
def test_unsupported(text):
    with pytest.raises(UnsupportedFilter):
        predicate(text)


def test_named_constants():
    assert parse("icmp[icmptype] = icmp-echo") == ("rel", "=", ("load", "icmp", ("num", 0), 1), ("num", 8))
    assert CONSTANTS["tcp-ack"] == 16


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tcpudiorhsan 0123.[]()&|<>=-/", max_size=30))
def test_parser_never_breaks(text):
    try:
        parse(text)
    except FilterError:
        pass
