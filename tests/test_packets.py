import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netcask import cli
from netcask.functions import headers
from netcask.operators import balance, edit, files, generate, metrics, order, select, stamps, timing
from netcask.operators.ticks import LOST_SYNC, NO_SYNC, TickClock
from netcask.plans.graph import Graph, parse_number, parse_size, parse_spec
from netcask.plans.ranges import index_ranges, time_range
from netcask.plans.streamspec import fields
from netcask.queries import ORACLE_SQL, QUERIES
from netcask.sources import packed, pcap
from netcask.sources.packetview import packets


def test_order_helpers_match_plain_folds(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(100)) for i in sorted(r.sample(range(5000), 700))]
    df = spark.createDataFrame(rows, "pkt_idx long, v long").repartition(7)
    width = 64
    d = order.with_position(df, width=width)
    d = order.with_prefix_sum(d, F.col("v"), "sum", width=width)
    d = order.with_running_max(d, F.col("v"), "most", width=width)
    d = order.with_previous(d, F.col("v"), "prev", width=width)
    got = sorted(map(tuple, d.select("pkt_idx", "pos", "sum", "most", "prev").collect()))
    want, total, most, prev = [], 0, 0, None
    for pos, (i, v) in enumerate(rows):
        most = max(most, v)
        want.append((i, pos, total, most, prev))
        total, prev = total + v, v
    assert got == want


def test_header_round_trip(spark, sf):
    d = packets(spark, sf, True)
    back = headers.with_headers(d.select("pkt_idx", "data"))
    cols = ["pkt_idx", "src_ip", "dst_ip", "ip_proto", "sport", "dport", "vlan_id"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, d.select(*cols).collect()))


def test_short_reads_are_null(spark):
    row = spark.createDataFrame([(bytearray(b"\x01"),)], "data binary").select(headers.read_be(F.col("data"), 0, 2), headers.read_be(F.col("data"), 0, 1)).first()
    assert tuple(row) == (None, 1)


@pytest.mark.parametrize("text", ["", "5-3", "3,1", "-", "a", "1-,5"])
def test_bad_index_ranges(text):
    with pytest.raises(ValueError):
        index_ranges(text)


def test_time_ranges():
    assert [m and (m.kind, m.ns) for m in time_range("1.5s-+2m")] == [("first", 1_500_000_000), ("start", 120_000_000_000)]
    assert time_range("2024-01-01 00:00:00-")[0].kind == "date"
    assert time_range("10:00:00-2024/01/02 11:00:00")[1].kind == "date"
    for bad in ("-", "+1s-2s", "x-y", "25:00:00-"):
        with pytest.raises(ValueError):
            time_range(bad)


def test_stream_specs():
    assert fields("udp:vid=3,1.2.3.4:80,5.6.7.8:90") == {"ip_protocol": 17, "vid": 3, "dhost": 0x01020304, "dport": 80, "shost": 0x05060708, "sport": 90}
    assert fields("eth:00:11:22:33:44:55") == {"dmac": "001122334455"}
    assert fields("dhost=1.2.3.4,tcp,ip") == {"dhost": 0x01020304, "ip_protocol": 6, "eth_type": 0x0800}
    for bad in ("tcp:1.2.3.4", "nope=1", "vid=5000"):
        with pytest.raises((ValueError, KeyError)):
            fields(bad)


def test_all_and_mismatch_streams(spark, sf):
    pk = packets(spark, sf)
    assert select.stream_filter(pk, "all").count() == pk.count()
    assert select.stream_filter(pk.withColumn("flags", F.lit(8)), "mismatch").count() == pk.count()


def build_pcap(order, magic, rows):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for sec, sub, data, length in rows:
        out += struct.pack(order + "IIII", sec, sub, len(data), length) + data
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize(("magic", "unit"), [(0xA1B2C3D4, 1000), (0xA1B23C4D, 1)])
def test_classic_files(order, magic, unit):
    blob = build_pcap(order, magic, [(7, 5, b"abc", 3), (8, 6, b"abcdef", 900)])
    assert list(pcap.packets_of(blob)) == [(7_000_000_000 + 5 * unit, 0, 3, b"abc"), (8_000_000_000 + 6 * unit, 4, 900, b"abcdef")]
    assert list(pcap.packets_of(blob[:-1])) == [(7_000_000_000 + 5 * unit, 0, 3, b"abc")]  # the last record is cut off
    assert list(pcap.packets_of(blob[:24])) == []


def test_bad_files():
    for blob in (b"", b"abc", b"\0" * 40):
        with pytest.raises(pcap.CaptureError):
            list(pcap.packets_of(blob))


@pytest.mark.parametrize("order", "<>")
def test_pcapng(order):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)

    nano = struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HHq", 14, 8, 100)
    blob = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHI", 1, 0, 4) + nano) + block(1, struct.pack(order + "HHI", 1, 0, 0))
    blob += block(6, struct.pack(order + "IIIII", 0, 0, 5, 3, 3) + b"abc") + block(6, struct.pack(order + "IIIII", 1, 0, 7, 2, 9) + b"xy") + block(3, struct.pack(order + "I", 6) + b"abcd") + block(99, b"skip")
    blob += block(2, struct.pack(order + "HHIIII", 0, 0, 0, 9, 1, 1) + b"z")
    assert list(pcap.packets_of(blob)) == [(100_000_000_005, 0, 3, b"abc"), (7000, 4, 9, b"xy"), (0, 4, 6, b"abcd"), (100_000_000_009, 0, 1, b"z")]


def test_write_and_read_files(spark, sf, tmp_path):
    pk = packets(spark, sf, True).select("pkt_idx", "ts_ns", F.col("frame_len").cast("int"), "data").limit(300)
    pcap.register(spark)
    out = str(tmp_path / "out")
    pk.repartition(3).write.format("pcap").mode("append").save(out)
    for back in (spark.read.format("pcap").load(out), pcap.read_pcap(spark, out)):
        assert sorted((r["ts_ns"], r["frame_len"], bytes(r["data"])) for r in back.collect()) == sorted((r["ts_ns"], r["frame_len"], bytes(r["data"])) for r in pk.collect())
    assert spark.read.format("pcap").option("snap", 10).load(out).agg(F.max(F.length("data"))).first()[0] == 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 * 10**9 - 1), st.integers(0, 65535), st.binary(max_size=200)), max_size=30), st.integers(300, 2000))
def test_packed_round_trip(rows, size):
    buffers = list(packed.pack(iter(rows), size))
    assert all(len(b) <= max(size, 216) for b in buffers)
    assert [(t, n, d) for b in buffers for t, _, n, d in packed.unpack(b)] == rows


def test_packed_flags():
    blob = packed.HEADER.pack(0, 16, packed.BAD_FCS | packed.BAD_L4, 2, 60, 1, 2) + b"ab"
    assert list(packed.unpack(blob)) == [(1_000_000_002, 3, 60, b"ab")]


def test_switch48_wraps_both_ways(spark):
    def one(host_sec, carried):
        head = bytes(12) + bytes.fromhex("d28b00010020") + struct.pack(">HI", carried, 5) + b"\x08\x00rest"
        return (0, host_sec * 10**9, 0, 100, bytearray(head), 0)

    rows = [one(65536 * 10 + 2, 65535), one(65536 * 10 - 1, 3), one(65536 * 10 + 7, 7)]
    df = spark.createDataFrame(rows, "pkt_idx long, ts_ns long, flags int, frame_len int, data binary, src long")
    got = [r["ts_ns"] for r in stamps.switch48(df).collect()]
    assert got == [(65536 * 10 - 1) * 10**9 + 5, (65536 * 10 + 3) * 10**9 + 5, (65536 * 10 + 7) * 10**9 + 5]
    other = df.withColumn("data", F.lit(bytes(40)))
    assert {r["stamped"] for r in stamps.switch48(other).collect()} == {False}


def test_switch64_rollover(spark):
    def one(i, host, t):
        return (i, host, 0, 100, bytearray(bytes(12) + bytes.fromhex("d28b00010010") + struct.pack(">II", *divmod(t, 10**9)) + b"\x08\x00"), 0)

    s = 10**9
    rows = [one(0, 101 * s, 100 * s), one(1, 104 * s + s // 2, 107 * s + s - 1000)]  # the second is a cycle ahead
    df = spark.createDataFrame(rows, "pkt_idx long, ts_ns long, flags int, frame_len int, data binary, src long")
    got = {r["pkt_idx"]: r["ts_ns"] for r in stamps.switch64(df, window_ns=s).collect()}
    assert got == {0: 100 * s, 1: 103 * s + s - 1000}


def test_footer_passes_bad_packets_unchanged(spark, sf):
    d = stamps.footer_encap(packets(spark, sf, True), port=3)
    late = stamps.footer_stamp(d.withColumn("ts_ns", F.col("ts_ns") + 10**12), has_fcs=False, max_diff_ns=10**9)
    assert late.where("port IS NOT NULL").count() == 0
    assert stamps.footer_stamp(d, has_fcs=False).where("port = 3").count() == packets(spark, sf).where("flags & 2 = 0").count()


def test_tick_clock():
    c = TickClock(nominal_hz=1e6)
    assert c.stamp(5, 0) == (NO_SYNC, None)
    c.keyframe(0, 10**9, 0)
    c.keyframe(10**6, 2 * 10**9, 10**9)
    assert c.stamp(10**6 + 500, 10**9 + 500_000) == ("", 2 * 10**9 + 500_000)
    assert c.stamp(10**6 - 500, 10**9 + 1) == ("", 2 * 10**9 - 500_000)
    assert c.stamp(0, 10**9 + 5)[0] == "no_timestamp"
    assert c.stamp(10**6 + 11 * 10**6, 12 * 10**9)[0] == LOST_SYNC
    assert c.stamp(1, 200 * 10**9)[0] == NO_SYNC
    bad = TickClock(nominal_hz=1e6)
    bad.keyframe(0, 10**9, 0)
    bad.keyframe(2 * 10**6, 2 * 10**9, 10**9)  # twice the nominal rate
    assert bad.state != "sync2"


def test_flow_key_is_symmetric(spark, sf):
    pk = packets(spark, sf)
    turn = {"src_ip": "dst_ip", "dst_ip": "src_ip", "sport": "dport", "dport": "sport"}
    swapped = pk.select(*[F.col(c).alias(turn.get(c, c)) for c in pk.columns])
    a, b = (sorted(map(str, balance.with_flow_key(d).select("pkt_idx", *balance.KEY).collect())) for d in (pk, swapped))
    assert a == b


def test_load_balance_keeps_flows_whole_and_even(spark, sf):
    d = balance.with_flow_key(balance.balance_least_load(packets(spark, sf), 4))
    assert d.groupBy(*balance.KEY).agg(F.countDistinct("output").alias("n")).where("n > 1").count() == 0
    loads = [r[1] for r in d.groupBy("output").agg(F.sum("cap_len")).collect()]
    assert len(loads) == 4 and max(loads) < 1.5 * min(loads)


def test_load_balance_is_a_greedy_fold(spark, sf):
    second = 1_000_000_000
    rows = [(i, i * 3 * second, 10 + i, 1, 6, 1000 + i, 80, None, 60, 60) for i in range(12)]  # flows that start on multiples of n seconds
    rows += [(100 + k, 40 * second + k, 99, 1, 6, 5000, 80, None, 1500, 1500) for k in range(50)]  # a heavy one
    rows += [(200 + i, 41 * second + i * second // 7, 200 + i, 1, 6, 7000, 80, None, 60 + i, 60 + i) for i in range(40)]
    small = spark.createDataFrame(rows, "pkt_idx long, ts_ns long, src_ip long, dst_ip long, ip_proto long, sport long, dport long, vlan_id long, frame_len long, cap_len long")
    for df, n in ((small.repartition(5), 3), (packets(spark, sf), 4)):
        work, first, of = {}, [], {}
        for r in balance.with_flow_key(df).orderBy("pkt_idx").collect():
            key = tuple(r[k] for k in balance.KEY)
            if key not in work:
                first.append(key)
            work[key] = work.get(key, 0) + 300 + r["cap_len"]
            of[r["pkt_idx"]] = key
        loads, output = [0] * n, {}
        for key in first:
            output[key] = loads.index(min(loads))
            loads[output[key]] += work[key]
        got = dict(map(tuple, balance.balance_least_load(df, n).select("pkt_idx", "output").collect()))
        assert got == {i: output[key] for i, key in of.items()}


def test_token_bucket_spaces_packets(spark):
    rows = [(i, 0, 100, 0) for i in range(50)]
    out = timing.token_bucket(spark.createDataFrame(rows, "pkt_idx long, ts_ns long, frame_len int, src long"), pps=1000).orderBy("pkt_idx").collect()
    gaps = {b["depart_ns"] - a["depart_ns"] for a, b in zip(out, out[1:], strict=False)}
    assert gaps == {1_000_000}


def test_delays():
    assert timing.delays_ns(3, 0, 100) == [0, 50_000, 100_000]
    assert timing.delays_ns(1, 7, 9) == [7000]
    with pytest.raises(ValueError):
        timing.delays_ns(2, 0, 2_000_000)


def test_size_rotation_of_all_packets(spark, sf):
    want, state = {}, {}
    for r in packets(spark, sf).select("src", "pkt_idx", "cap_len").orderBy("pkt_idx").collect():
        index, held = state.get(r["src"], (0, 24))
        if held >= 4096:
            index, held = index + 1, 24
        state[r["src"]] = index, held + 16 + r["cap_len"]
        want[r["pkt_idx"]] = index
    assert len(want) > 600
    assert dict(map(tuple, QUERIES["rotate_size"](spark, sf).collect())) == want


def test_queries_over_all_packets(spark, sf):
    n = packets(spark, sf).count()
    counts = {name: QUERIES[name](spark, sf).count() for name in ("repeater", "ts_adjust_pps", "replay_pipeline")}
    assert counts == {"repeater": 3 * n, "ts_adjust_pps": n, "replay_pipeline": packets(spark, sf).where("ip_proto = 17 and vlan_id is null").count()}


def test_repeat_of_a_long_capture(spark):
    z, n = 2_000_000_000_000_000, 5000
    d = timing.repeat(spark.range(n).selectExpr("id AS pkt_idx", f"id * {z // (n - 1)} AS ts_ns"), 2)
    last = z // (n - 1) * (n - 1)
    assert d.agg(F.max("ts_ns")).first()[0] == last + last * n // (n - 1)


@pytest.mark.parametrize("alpha", [0.5, 0.01])
def test_averages_reach_back_whatever_alpha_is(spark, alpha):
    r = random.Random(4)
    rows = [(i, (99_000 + i * 3 + r.randrange(3)) * 1000, 60 + i % 50, 70 + i % 90) for i in range(1000)]
    got = {x[0]: x[1:] for x in metrics.smoothed_rates(spark.createDataFrame(rows, "pkt_idx long, ts_ns long, cap_len long, frame_len long"), 1000, alpha).collect()}
    of, state, want = {ts // 1000: (1, cap * 8, link * 8) for _, ts, cap, link in rows}, (0.0, 0.0, 0.0), {}
    for period in range(min(of), max(of) + 1):
        state = tuple(x + alpha * (v * 1e6 - x) for x, v in zip(state, of.get(period, (0, 0, 0)), strict=True))
        if period in of:
            want[period] = state
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], rel=1e-9) for p in want)


def test_boundaries():
    assert [files.boundary(x) for x in (60, 90, 7, 3600, 4200, 86400)] == [60, 30, 1, 3600, 600, 86400]


def test_generator_defaults(spark):
    d = generate.generate(spark, 3)
    got = d.select(*[v.alias(k) for k, v in headers.decode(F.col("data")).items()]).first().asDict()
    assert (got["dmac"], got["smac"], got["src_ip"], got["sport"], got["dport"], got["ip_proto"]) == ("001122334455", "00667788" + "99aa", 0x01020304, 0x1234, 0x5678, 17)
    drawn = [r["sport"] for r in generate.generate(spark, 200, sport="r10-20").collect()]
    assert set(drawn) <= set(range(10, 21)) and len(set(drawn)) > 5


def test_sequence_check(spark):
    seqs = [5, 6, 9, 9, 3, 4]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "pkt_idx long, seq long")
    assert [(r["kind"], r["missing"]) for r in metrics.check_sequence(df).orderBy("pkt_idx").collect()] == [("ok", 0), ("ok", 0), ("gap", 2), ("repeat", 0), ("backwards", 0), ("ok", 0)]


def test_edit_leaves_other_frames(spark):
    arp = bytearray(bytes(12) + b"\x08\x06" + bytes(30))
    df = spark.createDataFrame([(0, 60, arp)], "pkt_idx long, frame_len int, data binary")
    assert bytes(edit.edit_headers(df, ip_source="1.1.1.1", dmac="ff:ff:ff:ff:ff:ff").first()["data"]) == bytes(arp)


def test_graph(spark, sf):
    pk = packets(spark, sf, True)
    g = Graph()
    src = g.source("in", pk)
    f = src.connect(g.node("filter:bpf=tcp", "f"))
    end = g.node("no_op", "end")
    f.connect(end)
    f.connect("not_matched", end)
    assert g.build()["end", ""].count() == pk.count()
    assert '"f" -> "end" [label="not_matched"]' in g.to_dot()
    with pytest.raises(ValueError):
        f.connect("nope", end)
    end.connect(f)
    with pytest.raises(ValueError):
        g.build()
    with pytest.raises(ValueError):
        g.node("unheard_of")


def test_specs_and_numbers():
    assert parse_spec("ts_adjust:pps=5k;offset_ns=3") == ("ts_adjust", {"pps": "5k", "offset_ns": "3"})
    assert [parse_number(x) for x in ("5k", "1.5M", 7)] == [5000, 1_500_000, 7]
    assert [parse_size(x) for x in ("5kB", "1MiB", "12")] == [5000, 1 << 20, 12]
    assert cli.parse_args(["a=1", "filter=x", "filter=y"]) == {"a": "1", "filter": "x;y"}
    with pytest.raises(ValueError):
        cli.parse_args(["a=1", "a=2"])


def test_streaming_matches_batch(spark, sf, tmp_path):
    from netcask.streaming import live

    pk = packets(spark, sf).withColumn("seq", F.when(F.col("pkt_idx") % 50 == 0, F.col("pkt_idx") + 9).otherwise(F.col("pkt_idx")))
    folder = str(tmp_path / "in")
    pk.orderBy("pkt_idx").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(pk.schema).parquet(folder)
    with pytest.raises(ValueError):
        live.refuse_streaming(stream, "pass_n")

    def finish(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    # each input by itself, in order, as the batch check has it
    kinds = finish(live.sequence_check(stream), "kinds")
    batch = {r["pkt_idx"]: r["kind"] for s in range(3) for r in metrics.check_sequence(pk.where(F.col("src") == s)).collect()}
    assert {r["pkt_idx"]: r["kind"] for r in kinds.collect()} == batch
    windows = finish(live.rates(stream, "1 hour"), "windows")
    want = {r["period"]: r["pkts"] for r in metrics.raw_rates(pk, 3_600_000_000_000).collect()}
    got = {int(r["start"].timestamp()) // 3600: r["pkts"] for r in windows.collect()}
    assert got and all(want[p] == n for p, n in got.items())


def test_pacing_script(spark):
    assert timing.parse_script("pps 10; for 2 s\npause 5 ms # wait\nspeedup 2;stop") == [("pps", 10.0), ("for", 2e9), ("pause", 5e6), ("speedup", 2.0), ("stop", 0)]
    for bad in ("fly 3", "pps", "pps -1", "for x s"):
        with pytest.raises(ValueError):
            timing.parse_script(bad)
    rows = [(i, 0, i * 10_000_000, 100) for i in range(6)]
    df = spark.createDataFrame(rows, "pkt_idx long, src long, ts_ns long, cap_len long")

    def times(script):
        return [r["ts_ns"] for r in timing.adjust_script(df, script).orderBy("pkt_idx").collect()]

    assert times("speedup 2") == [i * 5_000_000 for i in range(6)]
    assert times("pps 1000") == [(i + 1) * 1_000_000 for i in range(6)]
    assert times("bw 800000") == [i * 1_000_000 for i in range(6)]
    assert times("pps 1000; for 2 ms; pause 7 ms; speedup 10") == [1_000_000, 2_000_000, 10_000_000, 11_000_000, 12_000_000, 13_000_000]
    assert times("pps 1000; for 3 ms; stop") == [1_000_000, 2_000_000, 3_000_000]


# captures in several files and parts


def _captures(folder, n_files=3, n=400):
    import struct as st

    r = random.Random(6)
    want = []
    for k in range(n_files):
        body = pcap.file_header()
        for i in range(n + k):
            data = bytes(r.randrange(256) for _ in range(r.randrange(14, 120)))
            ts = 1_700_000_000_000_000_000 + i * 1_000_003
            body += pcap.record(ts, len(data), data)
            want.append((k * pcap.FILE + i, ts, data))
        (folder / f"{k}.pcap").write_bytes(body + st.pack("<II", 1, 2))  # cut off in a header
    return want


def test_files_are_numbered_in_order(spark, tmp_path):
    want = _captures(tmp_path)
    got = sorted((r["pkt_idx"], r["ts_ns"], bytes(r["data"])) for r in pcap.read_pcap(spark, f"file://{tmp_path}/*.pcap").collect())
    assert got == want
    first = select.pass_n(pcap.read_pcap(spark, f"file://{tmp_path}/*.pcap"), 405)[""].collect()
    assert sorted(r["pkt_idx"] for r in first) == [w[0] for w in want[:405]]


@pytest.mark.parametrize("split", [700, 5000, 1 << 30])
def test_files_are_read_in_parts(spark, tmp_path, split):
    want = _captures(tmp_path)
    # payloads that look like headers, which a part may start in
    fake = b"".join(pcap.record(1_700_000_000_000_000_000, 60, b"") for _ in range(40))
    body = pcap.file_header() + b"".join(pcap.record(1_700_000_000_000_000_000 + i, len(fake), fake) for i in range(20))
    (tmp_path / "9.pcap").write_bytes(body)
    want += [(3 * pcap.FILE + i, 1_700_000_000_000_000_000 + i, fake) for i in range(20)]
    got = sorted((r["pkt_idx"], r["ts_ns"], bytes(r["data"])) for r in pcap.split_pcap(spark, str(tmp_path), split).collect())
    assert got == want


def test_modified_headers_are_read():
    import struct as st

    head = st.pack("<IHHiIII", 0xA1B2CD34, 2, 4, 0, 0, 65535, 1)
    rec = st.pack("<IIIIIHBB", 5, 7, 4, 9, 1, 0x0800, 0, 0) + b"abcd"
    assert list(pcap.packets_of(head + rec * 2)) == [(5_000_007_000, 4, 9, b"abcd")] * 2


def test_one_writer_rotates_and_appends(spark, tmp_path):
    rows = [(i, 10_000_000_000 + i * 500_000_000, 100, bytes(100)) for i in range(60)]
    df = spark.createDataFrame(rows, "pkt_idx long, ts_ns long, frame_len int, data binary")
    got = {r["file"].rsplit("/", 1)[1]: (r["pkts"], r["bytes"]) for r in pcap.write_captures(df, str(tmp_path / "a"), "cap_$i_%H%M%S.pcap", rotate_seconds=10, rotate_bytes=1500).collect()}
    assert got == {f"cap_{i}_0000{s}.pcap": (n, 24 + 116 * n) for s in (10, 20, 30) for i, n in ((0, 13), (1, 7))}
    once = pcap.write_captures(df, str(tmp_path / "b"), "all.pcap").collect()
    assert [r["pkts"] for r in once] == [60]
    pcap.write_captures(df, str(tmp_path / "b"), "all.pcap", append=True).collect()
    back = list(pcap.packets_of((tmp_path / "b" / "all.pcap").read_bytes()))
    assert [t for t, *_ in back] == [r[1] for r in rows] * 2
    with pytest.raises(Exception, match="another kind"):
        pcap.write_captures(df, str(tmp_path / "b"), "all.pcap", append=True, nanoseconds=False).collect()
    pcap.write_captures(df.limit(0), str(tmp_path / "c")).collect()
    done = pcap.write_captures(df, str(tmp_path / "d"), "tmp", rotate_seconds=10, postrotate="done_%S_$i.pcap").collect()
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["done_10_0.pcap", "done_20_0.pcap", "done_30_0.pcap"] and len(done) == 3


# footers, stamps, draws


def test_extension_without_a_final_word(spark):
    from netcask.operators import stamps

    foot = bytes.fromhex("AABBCCDD" + "12345600" + "00000005" + "00000007" + "03" + "0102" + "07" + "55555555")
    df = spark.createDataFrame([(0, 9, 0, 24 + len(foot), bytes(24) + foot)], "pkt_idx long, ts_ns long, flags int, frame_len int, data binary")
    r = stamps.footer_stamp(df, extensions=True).collect()[0]
    assert (r["ts_ns"], r["frame_len"], r["flags"], len(r["data"])) == (5_000_000_007, 24 + len(foot) - 16, 0, 24 + len(foot) - 16)


def test_switch_rules(spark):
    from netcask.operators import stamps

    def frame(kind="D28B", version="0020", sec=5, ns=7, source="001122334455"):
        return bytes.fromhex("FFFFFFFFFFFF" + source + kind + "0001" + version + f"{sec:04X}{ns:08X}" + "0800" + "00" * 30)

    cases = [(frame(), 0, True), (frame(kind="88CC"), 0, False), (frame(), 2, False), (frame(version="0030"), 0, False), (frame(ns=10**9), 0, False), (frame()[:20], 0, False), (frame(source="ABCDEF000000"), 0, False)]
    df = spark.createDataFrame([(i, 0, f, len(d), d) for i, (d, f, _) in enumerate(cases)], "pkt_idx long, ts_ns long, flags int, frame_len int, data binary")
    out = stamps.switch_stamps(df, "7280", no_stamp_oui="ab:cd:ef")
    assert sorted(r["pkt_idx"] for r in out[""].collect()) == [i for i, c in enumerate(cases) if c[2]]
    assert out["no_timestamp"].count() == 6 and out["lldp"].count() == 0
    late = spark.createDataFrame([(0, 65_535 * 10**9, 0, 60, frame(sec=1)), (1, 65_537 * 10**9, 0, 60, frame(sec=65_535))], "pkt_idx long, ts_ns long, flags int, frame_len int, data binary")
    got = {r["pkt_idx"]: (r["ts_ns"], r["rollover"]) for r in stamps.switch48(late).collect()}
    assert got == {0: (65_537 * 10**9 + 7, True), 1: (65_535 * 10**9 + 7, True)}
    for bad in ({"switch_model": "9"}, {"switch_model": "7150", "ts_format": "48bit"}, {"switch_model": "7280", "ts_format": "32bit"}):
        with pytest.raises(ValueError):
            stamps.switch_stamps(df, **bad)
    with pytest.raises(ValueError):
        stamps.switch48(df, in_source=True)


def test_draws_are_even(spark):
    from netcask.functions.draw import draw

    seen = [r[0] for r in spark.range(20000).select(draw(F.col("id"), 3) % 8).collect()]
    assert all(abs(seen.count(k) - 2500) < 250 for k in range(8))


def test_token_bucket_is_the_plain_one(spark):
    r = random.Random(2)
    at, rows = 0, []
    for i in range(300):
        at += r.randrange(0, 400_000)
        rows.append((i, at, r.randrange(60, 1500), 0))
    out = [x["depart_ns"] for x in timing.token_bucket(spark.createDataFrame(rows, "pkt_idx long, ts_ns long, frame_len int, src long"), pps=5000, bps=4e7).orderBy("pkt_idx").collect()]
    pkt, byt = [1, 200_000, 0, None], [60, 12_000, 0, None]
    now, want = 0, []
    for _, ts, size, _ in rows:
        now = max(now, ts)
        for b in (pkt, byt):
            b[3] = now if b[3] is None else b[3]
        while True:  # a step of time at each period's end
            for b in (pkt, byt):
                while b[3] + b[1] <= now:
                    b[3] += b[1]
                    b[2] = min(b[0], b[2] + b[0])
            if pkt[2] > 0 and byt[2] > 0:
                break
            now = min(b[3] + b[1] for b in (pkt, byt) if b[2] <= 0)
        pkt[2] -= 1
        byt[2] -= size
        want.append(now)
    assert out == want


def test_least_load_of_uneven_flows(spark):
    rows = [(i, i * 10**9, 1460 if i % 2 else 60, i, 1000 + i, 6, 5, 80, None) for i in range(40)]
    df = spark.createDataFrame(rows, "pkt_idx long, ts_ns long, cap_len long, src_ip long, dst_ip long, ip_proto long, sport long, dport long, vlan_id long")
    work = {r["output"]: r["w"] for r in balance.balance_least_load(df, 2).groupBy("output").agg(F.sum(300 + F.col("cap_len")).alias("w")).collect()}
    assert abs(work[0] - work[1]) <= 1760


def test_nodes_are_found_by_name_type_and_argument(spark):
    from netcask.plans.graph import Graph

    g = Graph()
    g.node("snap:snap=60", "cut")
    g.node("filter:bpf=tcp", "tcp_only")
    assert [n.name for n in g.find("c*")] == ["cut"] and [n.name for n in g.find("type=filter")] == ["tcp_only"] and [n.name for n in g.find("snap=6*")] == ["cut"]


def test_command_words(tmp_path):
    (tmp_path / "more").write_text("# settings\nsnap=60  # short\neth1=b.pcap\nfilter=tcp\nfilter=udp\n")
    words = ["filter=ip", "verbose", "snap:snap=40;x", "eth0=a.pcap", "filter=icmp", f"config_file={tmp_path}/more", "vss:"]
    got = cli.parse_command(words, {"filter", "snap", "streams"}, flags=("verbose",))
    first = ("snap", {"snap": "40", "x": ""})
    assert got == [
        {"extensions": [first], "filter": "icmp", "verbose": True, "snap": "60", "source": "eth0", "value": "a.pcap"},
        {"extensions": [first, ("vss", {})], "filter": "tcp;udp", "verbose": True, "source": "eth1", "value": "b.pcap"},
    ]
    assert cli.parse_command(["filter=a", "filter=b"], {"filter"}) == [{"extensions": [], "filter": "a;b"}]
    (tmp_path / "loop").write_text(f"config_file={tmp_path}/loop")
    with pytest.raises(ValueError):
        cli.parse_command([f"config_file={tmp_path}/loop"], set())


def test_files_in_parts_are_the_files(spark):
    """A capture's bytes are never in one row, parts read apart are numbered through, and packets of equal times stay apart."""
    r = random.Random(4)
    rows = [(i, i % 2, 5, 90, bytes([i % 256]) * r.randrange(60, 90)) for i in range(500)]
    df = spark.createDataFrame(rows, "pkt_idx long, src long, ts_ns long, frame_len int, data binary").repartition(3)
    parts = pcap.encode_parts(df, ["src"], snap=80, width=64)
    made = parts.orderBy("src", "part").collect()
    assert len(made) == 2 * (1 + 8) and max(len(x["content"]) for x in made) <= 32 * (16 + 80)
    whole = {x["src"]: x["content"] for x in pcap.encode_files(df, ["src"], snap=80).collect()}
    assert all(b"".join(x["content"] for x in made if x["src"] == s) == whole[s] for s in whole)
    got = pcap.decode_files(parts.select(F.col("src").cast("string").alias("path"), "part", "content", F.col("src").alias("file_no")))
    want = [(str(s), s * pcap.FILE + i, *p[:3], p[3]) for s in whole for i, p in enumerate(pcap.packets_of(whole[s]))]
    assert sorted((*x[:5], bytes(x[5])) for x in got.collect()) == sorted(want)


def test_round_trips_with_equal_times(spark, tmp_path):
    """A row a packet, as the SQL has it, where packets of a capture have the same time."""
    from .oracle import connect, same

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(90)
    top = ev.agg(F.max("event_id")).first()[0] // 3000 * 3000 + 3000
    ev.unionByName(ev.withColumn("event_id", F.col("event_id") + top)).coalesce(1).write.parquet(f"{tmp_path}/all")
    next(tmp_path.glob("all/*.parquet")).rename(tmp_path / "events.parquet")
    con = connect(tmp_path)
    for name in TIED:
        assert same(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name]) == 180


TIED = ["packed_roundtrip", "pcap_roundtrip", "tunnel_roundtrip", "serialise_roundtrip"]


@pytest.mark.parametrize(("size", "bps"), [(1 << 30, 10**6), (1 << 50, 10**11), (1 << 30, 99_999_999_977), (1 << 20, 7), (60, 10**6)])
def test_pacing_by_bits_of_much_data(spark, size, bps):
    """The bits sent, in billionths of a second, are more than a long holds."""
    df = spark.range(12).selectExpr("id AS pkt_idx", "id AS ts_ns", f"{size} + id AS frame_len", f"{size} + id AS cap_len")
    want = [(i, sum(size + k for k in range(i)) * 8 * 10**9 // bps) for i in range(12)]
    assert sorted(map(tuple, timing.adjust_bandwidth(df, bps).select("pkt_idx", "ts_ns").collect())) == want
    assert sorted(map(tuple, timing.paced(df, f"bw {bps}").select("pkt_idx", "release_ns").collect())) == want


def test_token_bucket_past_a_long(spark):
    """So few packets a second that the last leave after what a long holds."""
    df = spark.range(3000).selectExpr("id AS pkt_idx", "id AS ts_ns", "60 AS frame_len", "id % 2 AS src")
    out = timing.token_bucket(df, pps=1e-7).orderBy("src", "pkt_idx").collect()
    assert [int(x["depart_ns"]) for x in out] == [s + (i + 1) * 10**16 for s in (0, 1) for i in range(1500)]
    assert timing.token_bucket(df, pps=1.0).schema["depart_ns"].dataType.simpleString() == "bigint"


def test_folds_are_run_in_stretches(spark, monkeypatch):
    """No task of a fold gets all rows of a capture, and the states go on over stretches."""
    rows = [(i, i * 1000, i % 50, 60 + i % 7, i % 2) for i in range(400)] + [(None, 7, 1, 60, 0), (3, 3, 1, 60, None)]
    df = spark.createDataFrame(rows, "pkt_idx long, ts_ns long, cap_len long, frame_len long, src long").repartition(3)

    def run(state, t):
        longest = t.num_rows
        return state + longest, order.added(order.added(t, "at", order.pa.array(range(state, state + longest), order.pa.int64())), "rows", order.pa.array([longest] * longest, order.pa.int64()))

    schema = df.selectExpr("*", "0L AS at", "0L AS rows").schema
    got = order.fold(df, ["src"], [], 0, run, schema, width=32).collect()
    assert len(got) == 402 and max(x["rows"] for x in got) == 16
    assert {(x["pkt_idx"], x["src"]): x["at"] for x in got} == {(i, i % 2): i // 2 for i in range(400)} | {(None, 0): 200, (3, None): 0}


def test_size_rotation_over_stretches(spark):
    """Files that are longer and shorter than a stretch of the fold; limits below a header's size."""
    n = 3 * order.WIDTH
    df = spark.range(0, n, 97).selectExpr("id AS pkt_idx", "id * 31 % 300 AS cap_len", "0 AS src")
    for limit, snap in ((4096, None), (10, None), (200_000, 100)):
        want, index, held = [], 0, 24
        for i in range(0, n, 97):
            if held >= limit:
                index, held = index + 1, 24
            held += 16 + min(i * 31 % 300, snap or 300)
            want.append((i, index))
        assert sorted(map(tuple, files.rotate_by_size(df, limit, snap).select("pkt_idx", "file_index").collect())) == want


@pytest.mark.parametrize("size", [300, 1000, 5000, 50_000])
def test_packed_in_stretches_is_packed_in_one(spark, size):
    """Buffers shorter and longer than a stretch, packets larger than a buffer, equal indices, gaps."""
    r = random.Random(size)
    index = sorted(r.choices(range(900), k=300) + list(range(5000, 5200)))
    rows = [(None if i == 5100 else i, s, n, 90, bytes([n % 256]) * r.choice([0, 20, 60, 400])) for n, i in enumerate(index) for s in (0, None)]
    df = spark.createDataFrame(rows, "pkt_idx long, src long, ts_ns long, frame_len int, data binary").repartition(3)
    made = packed.pack_stream(df, size, width=64)
    again = packed.repack_stream(made, 700, buffers=3)
    for s in (0, None):
        mine = sorted((x for x in rows if x[1] == s), key=lambda x: (x[0] is None, x[0] or 0, len(x[4])))
        want = [[len(p[3]) for p in packed.unpack(b)] for b in packed.pack(iter(x[2:] for x in mine), size)]
        got = sorted((x["buffer_no"], bytes(x["buffer"])) for x in made.where(F.col("src").eqNullSafe(s)).collect())
        assert [n for n, _ in got] == list(range(len(want)))
        assert [[len(p[3]) for p in packed.unpack(b)] for _, b in got] == want
        stream = [(t, n, d) for _, b in got for t, _, n, d in packed.unpack(b)]
        assert sorted(t for t, _, _ in stream) == sorted(x[2] for x in mine)
        second = sorted((x["buffer_no"], bytes(x["buffer"])) for x in again.where(F.col("src").eqNullSafe(s)).collect())
        assert [n for n, _ in second] == list(range(len(second)))
        want = [[len(p[3]) for p in packed.unpack(b)] for b in packed.pack(iter(stream), 700)]
        assert [[len(p[3]) for p in packed.unpack(b)] for _, b in second] == want


def test_connections_in_parts(spark):
    """A connection's bytes are never in one row; links and ends in one part hold in the others."""
    from netcask.operators import encap

    rows = [(i, i % 2, 5, 0, 90, bytes([i % 256]) * 60, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "pkt_idx long, src long, ts_ns long, flags int, frame_len int, data binary, stream_id int").repartition(3)
    start = encap.handshake() + encap.link_message("a", 0) + encap.link_message("b", 1)
    parts = encap.connection_parts(encap.tunnel_messages(df), F.lit(bytearray(start)), F.lit(bytearray(encap.end_message(1))), width=64)
    made = parts.orderBy("src", "part").collect()
    assert len(made) == 2 * (2 + 5) and max(len(x["content"]) for x in made) < 32 * 100
    got = encap.decode_tunnels(parts.select(F.col("src").cast("string").alias("path"), "part", "content")).collect()
    whole = {s: b"".join(x["content"] for x in made if x["src"] == s) for s in (0, 1)}
    assert sorted((*x[:7], bytes(x[7])) for x in got) == sorted((str(s), i, *x) for s in whole for i, x in enumerate(encap.read_tunnel(whole[s])))
    assert {(x["path"], x["link"]) for x in got} == {("0", "a"), ("1", "b")}
    late = parts.withColumn("part", F.when(F.col("part") == (1 << 63) - 1, 0).otherwise(F.col("part") + 1)).select(F.col("src").cast("string").alias("path"), "part", "content")
    with pytest.raises(Exception, match="after the end of stream 1"):
        encap.decode_tunnels(late.where("path = '1'")).collect()


def test_no_sketch_for_each_flow(spark, sf):
    """The estimate takes distinct flows: its sketch is in no aggregate that groups by the flow."""
    plan = QUERIES["approximate_flows"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx_count_distinct" in line and "Aggregate" in line]
    assert sketches and all("flow" not in line.split("functions=")[0] for line in sketches)
