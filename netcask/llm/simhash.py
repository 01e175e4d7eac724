"""SimHash near-duplicates: 64-bit fingerprints, compared in bit-sliced blocks, joined to components.

Fingerprint: A-Z lower-cased; words are runs of bytes other than space and 0x09-0x0D; shingles of ``SHINGLE`` words
joined by a space, repeats included (fewer words: the whole sequence; none: fingerprint zero). A bit is set if it is
set in over half of the shingles' XXH64 values (seed 42).

Links: fingerprints that differ in at most ``RADIUS`` bits.

1. Equal fingerprints are one row from here on (``groupBy`` with a combine before its shuffle): copies, however many, cost nothing.
2. Candidates: the 64 bits are cut into ``RADIUS + s`` blocks. With at most ``RADIUS`` differing bits, at least ``s``
   blocks are equal, so a fingerprint is put under every set of ``s`` blocks. No link is missed. ``s`` is 2 (15 keys of 21
   bits) or, for more fingerprints, 3 (35 keys of 27 bits), 4 (70 of 32) or 5 (126 of 36), so that buckets keep their size.
3. Comparison: each bucket's fingerprints are stored as 64 vertical bit planes, 64 fingerprints to a word. For every
   fingerprint against every word of its bucket, planes are XORed with the fingerprint's bit and added by bitwise
   carry-save counters; after every few planes the words in which all lanes have passed the radius are abandoned.
4. A bucket emits a spanning star for each of its components, never all pairs. A bucket of over ``CHUNK``
   fingerprints is dealt in chunks, each two of which meet in a task of their own: whole, and of bounded size.
5. Components of the stars over all buckets (``components``), then the smallest id of each.

Defined cases: null text is an empty one (fingerprint zero, linked like any other); rows with a null id take part, and
an id is null only where a component has no other; repeated rows are rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize
from .components import components

SHINGLE, RADIUS, SEED = 4, 3 + 1, 42
#: At most so many fingerprints of a bucket meet in one task, twice.
CHUNK = 1024
#: Fingerprints of a bucket on average, at most, before keys grow longer.
FILL = 32
#: Pairs (fingerprint, word of 64 others) that are compared at a time.
STEP = 1 << 17
_STRIDE = 1 << 19
_PLACE = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z, and ASCII white space, only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(flat[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)
    counts = np.zeros(8 * 256, np.int64)  # how often each byte value stands at each of the eight places
    for at in range(0, len(h), _STRIDE):  # bounded memory for a text of any length
        counts += np.bincount((h[at : at + _STRIDE].view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=8 * 256)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t or b"", shingle) for t in (x.as_py() for x in b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_masks(radius: int, spare: int = 2) -> list[int]:
    """Masks of every set of ``spare`` of the ``radius + spare`` blocks of the 64 bits."""
    cuts = np.linspace(0, 64, radius + spare + 1).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [reduce(or_, some) for some in combinations(blocks, spare)]


def spare_blocks(n: int, radius: int) -> int:
    """Blocks to a key, so that a bucket of evenly spread fingerprints has ``FILL`` or fewer, if that can be."""
    return next((s for s in range(2, 5) if n >> 64 * s // (radius + s) <= FILL), 5)


def sliced(fps: np.ndarray, word_of: np.ndarray, lane_of: np.ndarray, words: int) -> np.ndarray:
    """Bit planes: plane j, word w holds bit j of the fingerprint in each lane."""
    planes = np.zeros((64, words), np.uint64)
    for lane in range(64):
        at = np.flatnonzero(lane_of == lane)  # a word once at most
        if len(at):
            for j in range(64):
                planes[j, word_of[at]] |= ((fps[at] >> np.uint64(j)) & np.uint64(1)) << np.uint64(lane)
    return planes


def within(planes: np.ndarray, fps: np.ndarray, words: np.ndarray, full: np.ndarray, radius: int) -> np.ndarray:
    """For each (fingerprint, word), the lanes at most ``radius`` bits away; ``full``: the lanes that hold anything."""
    bits = max(1, int(radius).bit_length())
    out = np.zeros(len(fps), np.uint64)
    live = np.arange(len(fps))
    count = [np.zeros(len(fps), np.uint64) for _ in range(bits)]
    past = ~full  # lanes that have passed the radius
    one = np.uint64(1)
    for j in range(64):
        carry = planes[j, words] ^ (np.uint64(0) - ((fps >> np.uint64(j)) & one))
        for k in range(bits):  # carry-save: add one bit to every lane's counter
            count[k], carry = count[k] ^ carry, count[k] & carry
        past |= carry
        if j % 4 == 3 or j == 63:
            over = _above(count, radius) | past
            keep = np.flatnonzero(over != ~np.uint64(0))
            if len(keep) < len(live):
                live, fps, words = live[keep], fps[keep], words[keep]
                count, past, over = [c[keep] for c in count], past[keep], over[keep]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over ``radius``."""
    above = np.zeros_like(count[0])
    equal = ~above
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def stars(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links within each bucket. Rows are sorted by bucket; fingerprints are distinct in one."""
    n = len(fps)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(first, n))
    where = np.repeat(np.arange(len(first)), sizes)
    place = np.arange(n) - first[where]
    words_in = -(-sizes // 64)
    word0 = np.concatenate(([0], np.cumsum(words_in)[:-1]))
    word_of, lane_of = word0[where] + place // 64, place % 64
    planes = sliced(fps, word_of, lane_of, int(words_in.sum()))
    full = np.zeros(int(words_in.sum()), np.uint64)
    np.bitwise_or.at(full, word_of, np.uint64(1) << lane_of.astype(np.uint64))
    todo = words_in[where]
    total = np.cumsum(todo)
    left, right = [], []
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        rows = np.repeat(np.arange(at, upto), todo[at:upto])
        words = word0[where[rows]] + np.arange(len(rows)) - np.repeat(total[at:upto] - todo[at:upto] - (total[at - 1] if at else 0), todo[at:upto])
        hits = within(planes, fps[rows], words, full[words], radius)
        some = np.flatnonzero(hits)
        lanes = np.unpackbits(hits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, lane = np.nonzero(lanes)
        i = rows[some[r]]
        j = first[where[i]] + (words[some[r]] - word0[where[i]]) * 64 + lane
        keep = i < j
        left.append(i[keep])
        right.append(j[keep])
        at = upto
    a, b = np.concatenate(left), np.concatenate(right)
    root = roots(n, a, b)
    leaf = np.flatnonzero(root != np.arange(n))
    return fps[leaf], fps[root[leaf]]


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, spare: int | None = None) -> DataFrame:
    """Star edges (u, v) over distinct fingerprints ``fp`` that span every link."""
    spare = spare or spare_blocks(distinct.count(), radius)
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for t, m in enumerate(block_masks(radius, spare))]
    put = distinct.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.t", "b.k")
    sizes = materialize(put.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")))
    dealt = (
        put.join(sizes, ["t", "k"])
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select("fp", F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "t", "k")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            u, v = stars(rows["fp"], rows["bucket"], radius) if len(rows) else (np.empty(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            rows = np.empty(b.num_rows, [("bucket", np.int64), ("fp", np.uint64)])
            rows["bucket"], rows["fp"] = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            kept.append(rows)
            if rows["bucket"][0] != rows["bucket"][-1]:
                rows = np.concatenate(kept)
                cut = int(np.searchsorted(rows["bucket"], rows["bucket"][-1]))  # the last bucket may go on
                kept = [rows[cut:]]
                yield solve(rows[:cut])
        if kept:
            yield solve(np.concatenate(kept))

    # Buckets are told apart by a 64-bit hash of their key: if two ever share one, they are only compared as one.
    return dealt.select("bucket", "fp").distinct().repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id that links reach, its own included)."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    of = materialize(components(links(distinct, radius)), "simhash-roots")
    linked = of.join(distinct, of["node"] == distinct["fp"]).select("node", "root", "id")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    of = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    ids = materialize(distinct.join(of, "fp", "left").select("fp", F.coalesce("least", "id").alias("component")), "simhash-ids")
    return rows.join(ids, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, and of equal ids the smallest digest of the text; of equal rows one."""
    who, t, k = (free_name(docs, x) for x in ("who", "t", "k"))
    named = docs.withColumn(t, F.xxhash64(text_col)).withColumn(k, F.xxhash64(id_col, F.isnull(id_col)))
    rows = materialize(fingerprints(named.withColumn(who, F.struct(F.isnull(id_col).alias("n"), F.col(id_col).alias("i"), F.col(t).alias("t"), F.col(k).alias("k"))), who, text_col, shingle), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    of = materialize(components(links(distinct, radius)), "simhash-roots")
    linked = of.join(distinct, of["node"] == distinct["fp"])
    kept = linked.groupBy("root").agg(F.min("id").alias("id")).select("id")
    alone = distinct.join(of.select(F.col("node").alias("fp")), "fp", "left_anti").select("id")
    stay = materialize(kept.unionByName(alone).select(F.col("id.k").alias(k), F.col("id.t").alias(t)), "simhash-kept")
    # equal rows are combined before the shuffle that the join then needs no other for
    return named.dropDuplicates([k, t]).join(stay, [k, t], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
