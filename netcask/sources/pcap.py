"""Capture files: a Python data source ``pcap`` for reading (classic in four byte-order and resolution variants, and pcapng) and writing.

Reading lists files through Spark's own file source, so any store that Spark reads will do: ``read_pcap`` loads them with ``binaryFile`` and decodes
in Arrow batches, a file to a task, in memory; ``split_pcap`` reads large files in parts, ``encode_parts`` makes them. ``register`` adds the data source for paths that Python can open."""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import TRUNCATED, whole_div

NS = 1_000_000_000
# Magic numbers of the formats.
MAGIC_US, MAGIC_NS, MAGIC_MODIFIED, MAGIC_NG, ORDER_NG = 0xA1B2C3D4, 0xA1B23C4D, 0xA1B2CD34, 0x0A0D0D0A, 0x1A2B3C4D
#: Numbers of packets that are kept for each file of several.
FILE = 1 << 40
PACKETS = "path string, pkt_idx long, ts_ns long, flags int, frame_len int, data binary"


class CaptureError(ValueError):
    """Not a capture file."""


def packets_of(blob: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(ts_ns, flags, frame_len, data) of each packet. A record that the file ends in is left out."""
    if len(blob) < 4:
        raise CaptureError("too short for a capture file")
    if struct.unpack_from("<I", blob)[0] == MAGIC_NG:
        yield from _packets_ng(blob)
        return
    layout = layout_of(blob)
    yield from records(blob, 24, layout)


@dataclass(frozen=True)
class Layout:
    """Of a classic file: byte order, nanoseconds a unit of time, bytes of a record's header (the modified form has eight more), snap length and link type."""

    order: str
    unit: int
    head: int
    snap: int
    link: int


def layout_of(head: bytes) -> Layout:
    """From the first 24 bytes."""
    for order in "<>":
        magic = struct.unpack_from(order + "I", head)[0]
        if magic in (MAGIC_US, MAGIC_NS, MAGIC_MODIFIED):
            snap, link = struct.unpack_from(order + "II", head, 16) if len(head) >= 24 else (0, 1)
            return Layout(order, 1 if magic == MAGIC_NS else 1000, 24 if magic == MAGIC_MODIFIED else 16, snap, link)
    raise CaptureError(f"unknown magic number {head[:4].hex()}")


def records(blob: bytes, at: int, layout: Layout) -> Iterator[tuple[int, int, int, bytes]]:
    header, unit = struct.Struct(layout.order + "IIII"), layout.unit
    while at + layout.head <= len(blob):
        sec, sub, size, length = header.unpack_from(blob, at)
        at += layout.head
        if at + size > len(blob):
            return
        yield sec * NS + sub * unit, TRUNCATED if size < length else 0, length, blob[at : at + size]
        at += size


def _options(body: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        out[code] = body[at + 4 : at + 4 + size]
        at += 4 + size + (-size % 4)
    return out


def _packets_ng(blob: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    order, at = "<", 0
    interfaces: list[tuple[int, int, int]] = []  # units a second, offset in seconds, snap length
    while at + 12 <= len(blob):
        kind = struct.unpack_from(order + "I", blob, at)[0]
        if kind == MAGIC_NG:
            order = "<" if struct.unpack_from("<I", blob, at + 8)[0] == ORDER_NG else ">"
            if struct.unpack_from(order + "I", blob, at + 8)[0] != ORDER_NG:
                raise CaptureError("unknown byte order")
            interfaces = []
        size = struct.unpack_from(order + "I", blob, at + 4)[0]
        if size < 12 or at + size > len(blob):
            return
        body = blob[at + 8 : at + size - 4]
        at += size
        if kind == 1:
            snap = struct.unpack_from(order + "I", body, 4)[0]
            opts = _options(body[8:], order)
            res = opts.get(9, b"\x06")[0]
            units = 1 << (res & 0x7F) if res & 0x80 else 10**res
            offset = struct.unpack(order + "q", opts[14])[0] if len(opts.get(14, b"")) == 8 else 0
            interfaces.append((units, offset, snap))
        elif kind in (6, 2):
            if kind == 6:
                which, high, low, size_, length = struct.unpack_from(order + "IIIII", body)
            else:
                which, _, high, low, size_, length = struct.unpack_from(order + "HHIIII", body)
            if which >= len(interfaces):
                raise CaptureError(f"packet of interface {which}, which isn't described")
            units, offset, _ = interfaces[which]
            stamp = high << 32 | low
            yield stamp * NS // units + offset * NS, TRUNCATED if size_ < length else 0, length, body[20 : 20 + size_]
        elif kind == 3:
            length = struct.unpack_from(order + "I", body)[0]
            snap = interfaces[0][2] if interfaces else 0
            size_ = min(length, snap) if snap else length
            yield 0, TRUNCATED if size_ < length else 0, length, body[4 : 4 + size_]


def file_header(nanoseconds: bool = True, snap: int = 65535) -> bytes:
    return struct.pack("<IHHiIII", MAGIC_NS if nanoseconds else MAGIC_US, 2, 4, 0, 0, snap, 1)


def record(ts_ns: int, frame_len: int, data: bytes, nanoseconds: bool = True, snap: int = 65535) -> bytes:
    data = data[:snap]
    sec, sub = divmod(ts_ns, NS)
    return struct.pack("<IIII", sec, sub if nanoseconds else sub // 1000, len(data), frame_len) + data


#: Packets that are handed on at a time.
CHUNK = 1 << 14


def _tables(name: str, first: int, rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, CHUNK)):
        cols, n = list(zip(*some, strict=True)), len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())],
            names=["path", "pkt_idx", "ts_ns", "flags", "frame_len", "data"],
        )
        first += n


def decode_files(df: DataFrame) -> DataFrame:
    """Packets of the files in (path, content); ``pkt_idx`` counts in each file, from ``FILE`` times the column ``file_no``, where there is one.

    With a column ``part`` a row is a part of a classic file, as ``encode_parts`` gives them, and each is read apart from the others."""
    d = df.select("path", "content", F.col("file_no") if "file_no" in df.columns else F.lit(0).cast("long").alias("file_no"), *(["part"] if "part" in df.columns else []))
    d = _with_head(d) if "part" in df.columns else d.withColumns({"_head": F.lit(None).cast("binary"), "_before": F.lit(0).cast("long")})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, blob, no, head, before = (b.column(c)[i].as_py() for c in range(5))
                yield from _tables(name, no * FILE + before, packets_of(blob) if head is None else records(blob, 0, layout_of(head)))

    return d.select("path", "content", "file_no", "_head", "_before").mapInArrow(decode, PACKETS)


#: Byte orders and bytes of a record's header that a classic file can have.
FORMS = [("<", 16), ("<", 24), (">", 16), (">", 24)]


def _with_head(d: DataFrame) -> DataFrame:
    """Add ``_head``, the file's header, and ``_before``, the number of packets in the parts before, to parts; those with the headers go. A first pass counts the packets of each part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, form, counts = [], [], []
            for part, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                blob = blob.as_py()
                layout = layout_of(blob) if part < 0 else None
                head.append(blob if layout else None)
                form.append(FORMS.index((layout.order, layout.head)) if layout else None)
                # the header stands in another part: what a file of each form would have here
                counts.append([0] * len(FORMS) if layout else [count(blob, order, size) for order, size in FORMS])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(head, pa.binary()), pa.array(form, pa.int32()), pa.array(counts, pa.list_(pa.int64()))], names=["path", "part", "_head", "_form", "_counts"]
            )

    kind = d.schema["part"].dataType.simpleString()
    seen = d.select("path", "part", "content").mapInArrow(scan, f"path string, part {kind}, _head binary, _form int, _counts array<long>")
    file, earlier = Window.partitionBy("path"), Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    known = seen.withColumns({"_head": F.max("_head").over(file), "_n": F.element_at("_counts", F.max("_form").over(file) + 1)})
    known = known.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("part >= 0").select("path", "part", "_head", "_before")
    return d.join(F.broadcast(known), ["path", "part"])  # a row a part, so that parts stay where they are


def count(blob: bytes, order: str, head: int) -> int:
    """Records of this form in bytes that begin with one."""
    size, at, n = struct.Struct(order + "I"), 0, 0
    while at + head <= len(blob):
        at += head + size.unpack_from(blob, at + 8)[0]
        if at > len(blob):
            break
        n += 1
    return n


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all files that ``path`` names, in order of the files' paths: the first file's are numbered from 0, the next one's from ``FILE``, and so on."""
    files = spark.read.format("binaryFile").load(path)
    names = files.select("path").withColumn("file_no", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))  # a row a file
    return decode_files(files.join(names, "path"))


#: Headers in a row that make a place in a file the start of a record.
CHAIN = 16


def _walk(f, at: int, size: int, layout: Layout, until: int, most: int | None = None) -> tuple[int, int]:
    """(end, records) from the record that starts at ``at`` to the first that starts at ``until`` or later. A record that the file ends in isn't counted."""
    header, n = struct.Struct(layout.order + "IIII"), 0
    buffer, base = b"", at
    while at < until and (most is None or n < most):
        if at + layout.head > size:
            return size, n
        if at - base + layout.head > len(buffer):
            f.seek(at)
            buffer, base = f.read(1 << 20), at
        length = header.unpack_from(buffer, at - base)[2]
        if at + layout.head + length > size:
            return size, n
        at, n = at + layout.head + length, n + 1
    return at, n


def _plausible(f, at: int, size: int, layout: Layout) -> bool:
    """Whether headers that a capture could have stand one after another from here, to the end of the file or ``CHAIN`` of them."""
    header, last = struct.Struct(layout.order + "IIII"), None
    for _ in range(CHAIN):
        if at == size:
            return True
        f.seek(at)
        head = f.read(16)
        if len(head) < 16:
            return last is not None
        sec, sub, length, whole = header.unpack(head)
        if sub >= NS // layout.unit or length > max(layout.snap, 262144) or whole < length or whole > 1 << 24 or (last is not None and abs(sec - last) > 86400):
            return False
        last = sec
        if at + layout.head + length > size:
            return True
        at += layout.head + length
    return True


def split_pcap(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Like ``read_pcap``, for large classic files in folders that Python can open on every machine: files are read in parts, each by a task of its own.

    A first pass looks in each part for a place where a chain of plausible headers starts, and walks to the part's end. A part holds if it starts where the one before
    ends; parts that don't are walked again with the one before, so records are those of a walk from the file's start. Of the parts, a row each, the driver sums counts to numbers."""
    name = path.removeprefix("file://")
    found = sorted(p for p in (glob.glob(f"{name}/*") if os.path.isdir(name) else glob.glob(name)) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))
    parts = [(no, p, a, min(a + split_bytes, size)) for no, p in enumerate(found) for size in [os.path.getsize(p)] for a in range(0, size, split_bytes)]
    span = "file_no long, path string, start long, stop long"

    def start_of(f, start: int, stop: int, size: int, layout: Layout) -> int | None:
        if start == 0:
            return 24
        return next((at for at in range(start, stop) if _plausible(f, at, size, layout)), None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, end, count = [], [], []
            for p, start, stop in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                with open(p, "rb") as f:
                    layout, size = layout_of(f.read(24)), os.path.getsize(p)
                    at = start_of(f, start, stop, size, layout)
                    e, n = _walk(f, at, size, layout, stop) if at is not None else (None, 0)
                first.append(at)
                end.append(e)
                count.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in (first, end, count))], names=[*b.schema.names, "first", "end", "n"])

    if not parts:
        return spark.createDataFrame([], PACKETS)
    spread = spark.createDataFrame(parts, span).repartition(min(len(parts), 4096))
    scanned = sorted(map(tuple, spread.mapInArrow(scan, span + ", first long, end long, n long").collect()))  # a row a part
    todo: list[tuple[int, str, int, int, int]] = []  # file, path, first record, where to stop, number of the first record
    at_file, reached, base = -1, 0, 0
    for no, p, _, stop, first, end, n in scanned:
        if no != at_file:
            at_file, reached, base = no, 24, no * FILE
        if reached >= stop:
            continue
        if first != reached:  # no record was found there, or one that isn't: walk from where the last part ended
            with open(p, "rb") as f:
                end, n = _walk(f, reached, os.path.getsize(p), layout_of(f.read(24)), stop)
        todo.append((no, p, reached, end, base))
        reached, base = end, base + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, first, end, at in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                with open(p, "rb") as f:
                    layout = layout_of(f.read(24))
                    f.seek(first)
                    rows = list(records(f.read(end - first), 0, layout))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(rows), pa.string()), pa.array(range(at, at + len(rows)), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["path", "pkt_idx", "ts_ns", "flags", "frame_len", "data"],
                )

    return spark.createDataFrame(todo, "file_no long, path string, first long, stop long, base long").repartition(min(len(todo), 4096)).mapInArrow(read, PACKETS)


def write_captures(
    df: DataFrame,
    folder: str,
    name: str = "capture",
    rotate_seconds: int | None = None,
    rotate_bytes: int | None = None,
    append: bool = False,
    postrotate: str | None = None,
    pad: int = 0,
    nanoseconds: bool = True,
    snap: int = 65535,
) -> DataFrame:
    """Write all packets as one stream to a folder that Python can open on every machine; (file, pkts, bytes) of each file.

    Rotation is by time, then by size within (see ``operators.files``, whose name templates ``name`` and ``postrotate`` are; the latter is what a file is called once it is
    complete). Without rotation there is one file. A file appears under its name when it is complete. ``append`` keeps what a file of that name holds, which must be of the same kind.
    Files are written by a task each, and a task that runs again writes the same."""
    from ..operators import files

    folder = folder.removeprefix("file://")
    d = df.withColumns({"_all": F.lit(0), "cap_len": F.length("data").cast("long")})
    d = files.rotate_by_time(d, rotate_seconds) if rotate_seconds else d.withColumn("file_start", F.lit(0).cast("long"))
    d = files.rotate_by_size(d, rotate_bytes, snap, ["_all", "file_start"]) if rotate_bytes else d.withColumn("file_index", F.lit(0))
    once = rotate_seconds is None and rotate_bytes is None
    named = d.withColumns({"_name": F.lit(name) if once else files.file_name(name, F.col("file_index"), F.col("file_start"), pad), "_final": files.file_name(postrotate, F.col("file_index"), F.col("file_start"), pad) if postrotate else F.lit(None).cast("string")})
    os.makedirs(folder, exist_ok=True)
    held = {e.name: e.stat().st_size for e in os.scandir(folder) if e.is_file()} if append else {}

    def write(key: tuple, table: pa.Table) -> pa.Table:
        first, final = key[0].as_py(), key[1].as_py()
        target, rows = f"{folder}/{final or first}", table.sort_by("pkt_idx")
        partial = f"{target}.{uuid.uuid4().hex}.partial"
        with open(partial, "wb") as f:
            before = held.get(first, 0)
            if before:
                with open(f"{folder}/{first}", "rb") as old:
                    whole = old.read(before)
                if whole[:4] != file_header(nanoseconds, snap)[:4]:
                    raise CaptureError(f"{first} is of another kind")
                f.write(whole)
            else:
                f.write(file_header(nanoseconds, snap))
            for t, n, data in zip(*(rows.column(c).to_pylist() for c in ("ts_ns", "frame_len", "data")), strict=True):
                f.write(record(t, n, data, nanoseconds, snap))
            size = f.tell()
        os.replace(partial, target)
        return pa.table({"file": pa.array([target]), "pkts": pa.array([table.num_rows], pa.int64()), "bytes": pa.array([size], pa.int64())})

    made = named.select("_name", "_final", "pkt_idx", "ts_ns", "frame_len", "data").groupBy("_name", "_final").applyInArrow(write, "file string, pkts long, bytes long")
    return df.sparkSession.createDataFrame(made.collect(), "file string, pkts long, bytes long")  # a row a file


def encode_files(df: DataFrame, by: list[str], nanoseconds: bool = True, snap: int = 65535) -> DataFrame:
    """One row for each file: ``by``, and the file's bytes. Rotation (see ``operators.files``) keeps a file bounded; ``encode_parts`` makes files of any length."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("pkt_idx")
        parts = [file_header(nanoseconds, snap)]
        parts += [record(t.as_py(), n.as_py(), d.as_py(), nanoseconds, snap) for t, n, d in zip(rows.column("ts_ns"), rows.column("frame_len"), rows.column("data"), strict=True)]
        return pa.table({**{c: pa.array([k.as_py()], k.type) for c, k in zip(by, key, strict=True)}, "content": pa.array([b"".join(parts)], pa.binary())})

    return df.groupBy(*by).applyInArrow(encode, f"{kinds}, content binary")


#: Index values of which a part of a file has the packets.
PART = 1 << 14


def encode_parts(df: DataFrame, by: list[str], nanoseconds: bool = True, snap: int = 65535, width: int = PART) -> DataFrame:
    """The files' bytes in parts (``by``, part, content), which in order of their numbers make the file: -1 is its header, the others have the packets of ``width`` index values each."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("pkt_idx")
        parts = [record(t, n, d, nanoseconds, snap) for t, n, d in zip(*(rows.column(c).to_pylist() for c in ("ts_ns", "frame_len", "data")), strict=True)]
        lead = {c: pa.array([k.as_py()], k.type) for c, k in zip(by, key[:-1], strict=True)}
        return pa.table(lead | {"part": pa.array([key[-1].as_py()], pa.int64()), "content": pa.array([b"".join(parts)], pa.binary())})

    d = df.withColumn("part", whole_div(F.col("pkt_idx"), width)).select(*by, "part", "pkt_idx", "ts_ns", "frame_len", F.substring("data", 1, snap).alias("data"))
    heads = df.select(*by).distinct().select(*by, F.lit(-1).cast("long").alias("part"), F.lit(bytearray(file_header(nanoseconds, snap))).alias("content"))
    return heads.unionByName(d.groupBy(*by, "part").applyInArrow(encode, f"{kinds}, part long, content binary"))


class PcapSource(DataSource):
    """``spark.read.format("pcap").load(path)`` and ``df.write.format("pcap").save(folder)``, for folders that Python can open on every machine."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> DataSourceReader:
        return PcapReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PcapWriter(self.options, schema.fieldNames())


@dataclass
class FilePart(InputPartition):
    path: str


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.snap = int(options.get("snap", 1 << 31))

    def partitions(self) -> list[FilePart]:
        found = sorted(glob.glob(f"{self.path}/*") if os.path.isdir(self.path) else glob.glob(self.path))
        return [FilePart(p) for p in found if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_"))]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            blob = f.read()
        for i, (ts, flags, length, data) in enumerate(packets_of(blob)):
            yield partition.path, i, ts, flags, length, data[: self.snap]


@dataclass
class Written(WriterCommitMessage):
    partial: str
    final: str


class PcapWriter(DataSourceWriter):
    """A file for each task, under a partial name until the job commits."""

    def __init__(self, options: dict, names: list[str]):
        self.path = options["path"].removeprefix("file://")
        self.ns = options.get("resolution", "ns") == "ns"
        self.snap = int(options.get("snap", 65535))
        self.names = names

    def write(self, rows) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = f"{self.path}/part-{uuid.uuid4().hex}.pcap"
        t, n, d = (self.names.index(x) for x in ("ts_ns", "frame_len", "data"))
        with open(name + ".partial", "wb") as f:
            f.write(file_header(self.ns, self.snap))
            for r in rows:
                f.write(record(r[t], r[n], bytes(r[d]), self.ns, self.snap))
        return Written(name + ".partial", name)

    def commit(self, messages) -> None:
        for m in messages:
            os.replace(m.partial, m.final)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.partial):
                os.remove(m.partial)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)
