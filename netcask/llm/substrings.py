"""Repeated byte strings: depth-limited radix passes over the suffixes of all texts.

A *window* is the first ``SPAN`` bytes of a suffix. A byte goes if a window that covers it also starts anywhere else, in
the same text or another. Suffixes are ordered only as far as needed to tell equal windows, most significant digits
first, and a class of one suffix is dropped at once. The digits are chosen so that a pass moves little data:

1. *Classes.* Each window is filed under the smallest hash among its ``GRAM``-byte grams (its anchor: equal windows
   have the anchor at the same place) and, by its distance to it, under one of three blocks of ``BLOCK`` windows. All windows of a
   class share a core of ``SPAN - BLOCK + 1`` bytes. First pass: digests of cores, about one for 50 bytes of text, are sorted; classes
   whose core is met once hold no repeated window and are dropped.
2. *Contexts.* For the rest, the second digit is a 128-bit digest of the whole stretch that a class's windows cover.
   Classes equal in it are equal in every window. One of each set is left standing for all. Contexts of one core go to
   different tasks: that a core has others is seen from its count, which is larger than the context's.
3. *Bytes.* Where one core has several contexts, one copy of each context is sent, and the windows in it are sorted by
   8-byte digits (``equal_windows``), singles dropped after each digit. What is left are the repeated windows, returned
   as a bit mask of at most ``BLOCK`` bits. Cores of over ``GROUP`` classes never meet in one task: where their contexts are, these are cut in windows, which are
   counted by 128-bit digest with a combine before the shuffle.

Equal texts are found by SHA-256 before any of this and enter once; all of a text that has a copy goes.
Texts are written once, deduplicated, bucketed by their digest, with their anchors. Every pass is a cogroup of that table
with the few messages for each bucket, so texts aren't shuffled again. Removed runs are judged on the
input.

Defined cases: null text is an empty one; texts shorter than a window lose nothing; repeated rows are copies of one another, so they lose
everything if long enough; an empty table gives an empty result; other columns are ignored; texts of any
length are taken whole, their anchors in strides of bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed_table, free_name, materialize, shuffle_partitions

SPAN, GRAM, BLOCK = 200, 40, 54
#: Classes of one core that meet in a task, at most.
GROUP = 1000
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 64 << 20
_STRIDE = 1 << 19
_SCATTER = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)
_BASE = 0x9E3779B1
CORE, SHIP, EQUAL, MASK = 1, 2, 3, 4
MESSAGE = "b int, kind int, h1 long, h2 long, value long"


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of every run of ``size`` bytes, by doubling."""
    one = _SCATTER[data]
    now, n, power = one, 1, _BASE
    for bit in bin(size)[3:]:
        now = now[:-n] * np.uint32(power) + now[n:]
        n, power = 2 * n, power * power & 0xFFFFFFFF
        if bit == "1":
            now = now[:-1] * np.uint32(_BASE) + one[n : n + len(now) - 1]
            n, power = n + 1, power * _BASE & 0xFFFFFFFF
    now = now ^ (now >> np.uint32(15))
    now = now * np.uint32(0x85EBCA77)
    return now ^ (now >> np.uint32(13))


def window_anchors(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors in order: (position, number of windows filed under it). Windows of an anchor are consecutive."""
    width, windows = span - gram + 1, len(data) - span + 1
    found = []
    for at in range(0, windows, _STRIDE):
        h = gram_hashes(data[at : at + _STRIDE + span - 1], gram)
        low = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if n < width:
            low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
        found.append((low & np.uint64(0xFFFFFFFF)).astype(np.int64) + at)
    place = np.concatenate(found)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], np.diff(np.append(first, len(place)))


def packed_anchors(text: bytes, span: int = SPAN, gram: int = GRAM) -> bytes:
    place, count = window_anchors(np.frombuffer(text, np.uint8), span, gram)
    return np.stack([np.diff(place, prepend=0), count]).astype("<u2").tobytes()


class Classes:
    """The classes of a text: anchor ``p`` and block ``g``, with the distances of the windows in it, ``lo`` to ``hi``."""

    def __init__(self, text: bytes, anchors: bytes):
        gap, count = np.frombuffer(anchors, "<u2").astype(np.int64).reshape(2, -1)
        p, end = np.cumsum(gap), np.cumsum(count)
        far, near = p - (end - count), p - end + 1  # distances from the anchor back to its first and last window
        parts = []
        for g in range((SPAN - GRAM) // BLOCK + 1):
            at = np.flatnonzero((near // BLOCK <= g) & (far // BLOCK >= g))
            parts.append((p[at], np.full(len(at), g)))
        self.text, self.size = text, len(text)
        self.p, self.g = (np.concatenate(x) for x in zip(*parts, strict=True))
        # every window that is there, filed here or not, as its partner may be filed differently near an edge
        self.lo = np.maximum(self.g * BLOCK, self.p - (self.size - SPAN))
        self.hi = np.minimum((self.g + 1) * BLOCK - 1, self.p)

    def cores(self) -> list[int]:
        a = self.p - self.g * BLOCK
        digest, view = xxhash.xxh3_64_intdigest, memoryview(self.text)
        return [digest(view[x : x + SPAN - BLOCK + 1], g) for x, g in zip(a.tolist(), self.g.tolist(), strict=True)]

    def context(self, k: int) -> tuple[int, int]:
        return int(self.p[k] - self.hi[k]), int(self.p[k] - self.lo[k]) + SPAN

    def context_digest(self, k: int) -> tuple[int, int]:
        """Equal for classes that have the same windows at the same distances."""
        a, b = self.context(k)
        seed = int(self.g[k]) | int(self.hi[k] - self.g[k] * BLOCK) << 8
        d = xxhash.xxh3_128_intdigest(memoryview(self.text)[a:b], seed)
        return signed(d >> 64), signed(d & (1 << 64) - 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_texts(table: pa.Table) -> Iterator[tuple[bytes, Classes]]:
    """The distinct texts of a bucket; tasks of the first pass may each have sent a copy."""
    seen = set()
    for tid, text, anchors in zip(*(table.column(c) for c in ("tid", "text", "anchors")), strict=True):
        tid = tid.as_py()
        if tid not in seen:
            seen.add(tid)
            yield tid, Classes(text.as_py(), anchors.as_py())


def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(rows, return_counts=True)


def core_rows(key: tuple, table: pa.Table) -> pa.Table:
    every = [np.array(c.cores(), np.uint64) for _, c in bucket_texts(table)]
    h, n = counted(np.concatenate(every) if every else np.empty(0, np.uint64))
    return pa.table({"h": h.view(np.int64), "b": np.full(len(h), key[0].as_py(), np.int32), "n": n})


class Messages:
    def __init__(self, table: pa.Table):
        kind = table.column("kind").to_numpy()
        h1, h2, value = (table.column(c).to_numpy() for c in ("h1", "h2", "value"))
        at = kind == CORE
        self.cores = dict(zip(h1[at].view(np.uint64).tolist(), value[at].tolist(), strict=True))
        of = {k: np.flatnonzero(kind == k) for k in (SHIP, EQUAL, MASK)}
        self.ship = {(x, y): v for x, y, v in zip(h1[of[SHIP]].tolist(), h2[of[SHIP]].tolist(), value[of[SHIP]].tolist(), strict=True)}
        self.equal = set(zip(h1[of[EQUAL]].tolist(), h2[of[EQUAL]].tolist(), strict=True))
        self.mask = {(x, y): v for x, y, v in zip(h1[of[MASK]].tolist(), h2[of[MASK]].tolist(), value[of[MASK]].tolist(), strict=True)}

    def classes(self, c: Classes) -> Iterator[tuple[int, int]]:
        """(class, core) of those whose core is repeated."""
        return ((k, core) for k, core in enumerate(c.cores()) if core in self.cores)


def context_rows(key: tuple, table: pa.Table, messages: pa.Table) -> pa.Table:
    told = Messages(messages)
    rows = [(signed(core), *c.context_digest(k), told.cores[core]) for _, c in bucket_texts(table) for k, core in told.classes(c)]
    u, n = counted(np.array(rows, [("core", "<i8"), ("s1", "<i8"), ("s2", "<i8"), ("total", "<i8")]))
    return pa.table({"core": u["core"], "s1": u["s1"], "s2": u["s2"], "total": u["total"], "b": np.full(len(u), key[0].as_py(), np.int32), "n": n})


def shipped_rows(key: tuple, table: pa.Table, messages: pa.Table, group: int) -> pa.Table:
    told = Messages(messages)
    out: list[list] = [[] for _ in range(8)]
    for _, c in bucket_texts(table):
        for k, core in told.classes(c):
            s = c.context_digest(k)
            multi = told.ship.pop(s, None)
            if multi is not None:
                a, b = c.context(k)
                lead = (int(c.g[k]) + 1) * BLOCK - 1 - int(c.hi[k])  # windows that the start of the text cuts off
                for col, x in zip(out, (signed(core), *s, key[0].as_py(), multi, lead, told.cores[core] > group, c.text[a:b]), strict=True):
                    col.append(x)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["core", "s1", "s2", "b", "multi", "lead", "common", "context"])


def final_rows(key: tuple, table: pa.Table, messages: pa.Table) -> pa.Table:
    told = Messages(messages)
    out: list[list] = [[] for _ in range(6)]
    for tid, c in bucket_texts(table):
        starts = []
        for k, _ in told.classes(c):
            s = c.context_digest(k)
            a, b = c.context(k)
            if s in told.equal:
                starts.append((a, b))
            elif s in told.mask:
                first = int(c.p[k]) - (int(c.g[k]) + 1) * BLOCK + 1  # where the window of bit 0 starts
                bits, at = told.mask[s], 0
                while bits >> at:
                    if bits >> at & 1:
                        run = at
                        while bits >> at & 1:
                            at += 1
                        starts.append((first + run, first + at - 1 + SPAN))
                    at += 1
        spans = merged(starts)
        if spans:
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(c.text[at:a])
                at = b
            kept.update(c.text[at:])
            for col, x in zip(out, (tid, sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [a for a, _ in spans], [b for _, b in spans]), strict=True):
                col.append(x)
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["tid", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def edges(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal keys starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def numpy_rows(batch: pa.RecordBatch) -> np.ndarray:
    cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
    rows = np.empty(batch.num_rows, [(n, c.dtype) for n, c in cols.items()])
    for n, c in cols.items():
        rows[n] = c
    return rows


def message_batch(b: np.ndarray, kind: int, h1: np.ndarray, h2: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    cols = (b.astype(np.int32), np.full(len(b), kind, np.int32), h1.astype(np.int64), h2.astype(np.int64), value.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["b", "kind", "h1", "h2", "value"])


def repeated_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, b, n) sorted by h. Tells each bucket which of its cores are met again anywhere, and how often. A core has a row for each bucket at most."""
    held = None

    def tell(rows: np.ndarray) -> pa.RecordBatch:
        at = edges(rows["h"])
        total = np.repeat(np.add.reduceat(rows["n"], at), np.diff(np.append(at, len(rows)))) if len(rows) else np.empty(0, np.int64)
        r = rows[total > 1]
        return message_batch(r["b"], CORE, r["h"], np.zeros(len(r)), total[total > 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = numpy_rows(batch)
        rows = rows if held is None else np.concatenate([held, rows])
        cut = int(np.searchsorted(rows["h"], rows["h"][-1]))
        held = rows[cut:]
        yield tell(rows[:cut])
    if held is not None:
        yield tell(held)


def equal_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (core, s1, s2, b, total, n) sorted by context; rows of one context are in one task, contexts of a core need not be.

    EQUAL to every bucket of a context met twice; SHIP to one bucket of each context whose core is met in others too: more often than the context is."""
    held = None

    def tell(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = edges(rows["core"], rows["s1"], rows["s2"])
        times = np.add.reduceat(rows["n"], at)
        r = rows[np.repeat(times > 1, np.diff(np.append(at, len(rows))))]
        yield message_batch(r["b"], EQUAL, r["s1"], r["s2"], np.zeros(len(r)))
        several = rows["total"][at] > times
        r = rows[at[several]]
        yield message_batch(r["b"], SHIP, r["s1"], r["s2"], times[several] > 1)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = numpy_rows(batch)
        rows = rows if held is None else np.concatenate([held, rows])
        cut = int(edges(rows["core"], rows["s1"], rows["s2"])[-1])
        if cut:
            yield from tell(rows[:cut])
        held = rows[cut:]
    if held is not None:
        yield from tell(held)


def laid_out(lead: list[int], contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts on a grid of full length, and which of the ``BLOCK`` windows each has."""
    grid = np.zeros((len(contexts), SPAN + BLOCK - 1), np.uint8)
    has = np.zeros((len(contexts), BLOCK), bool)
    for i, (skip, c) in enumerate(zip(lead, contexts, strict=True)):
        grid[i, skip : skip + len(c)] = np.frombuffer(c, np.uint8)
        has[i, skip : skip + len(c) - SPAN + 1] = True
    return grid, has


def equal_windows(group: np.ndarray, lead: list[int], contexts: list[bytes]) -> np.ndarray:
    """For each context, a mask of its windows that another context of the group has at the same place.

    A radix sort of windows, most significant digit first: class (group, place), then 8 bytes at a time; classes of one are dropped after each digit.
    All contexts of a group agree on the core, so only the bytes outside of it are digits."""
    grid, has = laid_out(lead, contexts)
    row, place = np.nonzero(has)
    depth = -(-(BLOCK - 1) // 8) * 8
    outside = np.arange(BLOCK - 1)
    # the window at w covers grid columns w to w + SPAN - 1; the core is columns BLOCK - 1 to SPAN - 1
    columns = np.stack([np.where(outside < BLOCK - 1 - w, w + outside, SPAN + outside - (BLOCK - 1 - w)) for w in range(BLOCK)])
    digits = np.zeros((len(row), depth), np.uint8)
    digits[:, : BLOCK - 1] = grid[row[:, None], columns[place]]
    digits = digits.view(np.uint64)
    kind = group[row] * BLOCK + place
    live = np.arange(len(row))
    for d in range(digits.shape[1]):
        digit = digits[live, d]
        order = np.lexsort((digit, kind))
        live, kind, digit = live[order], kind[order], digit[order]
        if not len(live):
            break
        at = edges(kind, digit)
        sizes = np.diff(np.append(at, len(live)))
        keep = np.repeat(sizes > 1, sizes)
        kind = np.repeat(np.arange(len(at)), sizes)[keep]
        live = live[keep]
    masks = np.zeros(len(contexts), np.int64)
    np.bitwise_or.at(masks, row[live], np.int64(1) << place[live])
    return masks


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts of common cores, a row for each window: where it stands, its digest, and the context it is of."""
    names = ["b", "h1", "h2", "multi", "core", "place", "w1", "w2"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            made = []
            for r in batch.slice(at, 500).to_pylist():
                for k in range(len(r["context"]) - SPAN + 1):
                    d = xxhash.xxh3_128_intdigest(r["context"][k : k + SPAN])
                    made.append((r["b"], r["s1"], r["s2"], r["multi"], r["core"], r["lead"] + k, signed(d >> 64), signed(d & (1 << 64) - 1)))
            cols = list(zip(*made, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def solve_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core, of few contexts each. MASK messages."""
    held: list[dict] = []

    def solve(rows: list[dict]) -> pa.RecordBatch:
        masks = equal_windows(np.unique([r["core"] for r in rows], return_inverse=True)[1], [r["lead"] for r in rows], [r["context"] for r in rows])
        some = [(r["b"], r["s1"], r["s2"], m) for r, m in zip(rows, masks.tolist(), strict=True) if m and not r["multi"]]
        b, h1, h2, m = (np.array([x[i] for x in some], np.int64) for i in range(4))
        return message_batch(b, MASK, h1, h2, m)

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            held += batch.slice(at, 1000).to_pylist()
            cut = len(held)
            while cut and held[cut - 1]["core"] == held[-1]["core"]:
                cut -= 1
            if cut:
                yield solve(held[:cut])
                held = held[cut:]
    if held:
        yield solve(held)


def repeated_spans(docs: DataFrame, text_col: str = "text", group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows, found). rows: the columns of ``docs`` but the text as the struct ``row``, with tid (SHA-256 of the text) and n_bytes.
    found: for each tid that loses bytes: n_removed, n_spans, kept_sha256, and its removed runs as starts, ends."""
    spark = docs.sparkSession
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    held, key = free_name(docs, "data"), free_name(docs, "tid")
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], data.alias(held), F.unhex(F.sha2(data, 256)).alias(key))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = materialize(keyed.select(F.struct(*kept).alias("row") if kept else F.lit(None).cast("int").alias("row"), F.col(key).alias("tid"), F.octet_length(held).cast("long").alias("n_bytes")), "substring-rows")
    buckets = max(shuffle_partitions(spark), -(-(rows.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep, anchors = [], []
            for i, (tid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                if tid not in seen:
                    seen.add(tid)
                    keep.append(i)
                    anchors.append(packed_anchors(text.as_py()))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(anchors, pa.binary())], names=["tid", "text", "anchors"])

    long_ones = keyed.where(F.octet_length(held) >= SPAN).select(F.col(key).alias("tid"), F.col(held).alias("text"))
    texts = long_ones.mapInArrow(prepare, "tid binary, text binary, anchors binary").withColumn("b", F.pmod(F.xxhash64("tid"), F.lit(buckets)).cast("int"))
    table = bucketed_table(texts, "substring-texts", buckets, "b")

    def told(f, messages: DataFrame, schema: str) -> DataFrame:
        return table.groupBy("b").cogroup(messages.groupBy("b")).applyInArrow(f, schema)

    cores = table.groupBy("b").applyInArrow(core_rows, "h long, b int, n long")
    core_messages = materialize(cores.repartition("h").sortWithinPartitions("h").mapInArrow(repeated_cores, MESSAGE), "substring-cores")
    contexts = told(context_rows, core_messages, "core long, s1 long, s2 long, total long, b int, n long")
    # dealt by context, not by core, which a third of all texts may share
    context_messages = materialize(contexts.repartition("core", "s1").sortWithinPartitions("core", "s1", "s2").mapInArrow(equal_contexts, MESSAGE), "substring-contexts")
    both = core_messages.unionByName(context_messages.where(F.col("kind") == SHIP))
    shipped = materialize(
        told(lambda key, table, messages: shipped_rows(key, table, messages, group), both, "core long, s1 long, s2 long, b int, multi long, lead int, common boolean, context binary"), "substring-contexts"
    )
    solved = materialize(shipped.where("NOT common").repartition("core").sortWithinPartitions("core").mapInArrow(solve_contexts, MESSAGE), "substring-solved")
    windows = materialize(shipped.where("common").mapInArrow(window_rows, "b int, h1 long, h2 long, multi long, core long, place int, w1 long, w2 long"), "substring-windows")
    window = ["core", "place", "w1", "w2"]
    again = windows.groupBy(*window).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    masks = (
        windows.where("multi = 0")
        .join(again.hint("merge"), window)
        .groupBy("b", "h1", "h2")
        .agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("value"))
        .select("b", F.lit(MASK).alias("kind"), "h1", "h2", "value")
    )
    messages = (
        core_messages.unionByName(context_messages.where(F.col("kind") == EQUAL))
        .unionByName(solved)
        .unionByName(masks)
    )
    found = materialize(told(final_rows, messages, "tid binary, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"), "substring-found")
    copied = rows.groupBy("tid").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("size")).where((F.col("copies") > 1) & (F.col("size") >= SPAN))
    whole = copied.select(
        "tid",
        F.col("size").alias("n_removed"),
        F.lit(1).cast("long").alias("n_spans"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"),
        F.array(F.lit(0).cast("long")).alias("starts"),
        F.array("size").alias("ends"),
    )
    # both sides grow with the input: never broadcast
    found = whole.unionByName(found.join(whole.select("tid").hint("merge"), "tid", "left_anti"))
    return rows, materialize(found, "substring-removed")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are left), starts and ends of the removed runs."""
    rows, found = repeated_spans(docs.select(id_col, text_col), text_col, group)
    return rows.join(found.hint("merge"), "tid", "left").select(
        F.col(f"row.`{id_col}`").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("tid"))).alias("kept_sha256"),
        "starts",
        "ends",
    )


def cut_text(text: bytes, starts: list[int], ends: list[int]) -> str:
    """The text without the runs; a run that begins or ends inside a character leaves that character whole."""
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append(text[at:a])
            at = b
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def drop_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated runs cut from the texts; all rows and columns stay, in their order."""
    _, found = repeated_spans(docs.select(text_col), text_col)

    @F.pandas_udf("string")
    def cut(text, starts, ends):
        return pd.Series([t if t is None or a is None else cut_text(t.encode(), a, b) for t, a, b in zip(text, starts, ends, strict=True)], dtype=object)

    key, a, z = (free_name(docs, x) for x in ("tid", "starts", "ends"))
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)))
    joined = keyed.join(found.select(F.col("tid").alias(key), F.col("starts").alias(a), F.col("ends").alias(z)).hint("merge"), key, "left")
    new = F.when(F.col(a).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(a), F.col(z)))
    return joined.select(*[(new.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
