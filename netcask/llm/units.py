"""Line hashing: repeated lines go, but for the earliest occurrence; with ``passage``, also runs of words that an earlier document has.

A text is cut at line breaks (a paragraph is a line here). Each unit that has a word is normalised (lower case, white space as one space) and
digested. Of equal digests the earliest by (id, digest of the text, place) stays and all others go, however short they are and whatever
stands around them. Units that go in a row are one span. Offsets are in characters of the original text. Two parameters are off unless
asked for: ``sentences`` cuts lines further after sentence ends, so that a passage set into a longer line is seen, and ``min_run`` keeps runs of fewer words.

Equal units within a batch are settled where they are read: only the earliest of them is sent on, so a
line found in a third of all documents is one row for each batch. Those rows are sorted by digest and read in one pass
that holds one row. What goes is sorted by document and read likewise. No group is ever gathered.

``passage`` (off unless asked for) makes each run of so many words a unit too, wherever lines begin and end, as a passage set into a longer line is in no line
of its own. Such a run goes if an earlier document has it; the first document with it keeps it. Runs that overlap go as one passage, counted as one unit.
Few runs are compared one by one: the least of a run's 8-word shingle hashes is its anchor, so equal runs have equal anchors. A stretch is what neighbouring
runs of one anchor cover. A stretch that an earlier document has goes as a whole. Of others, those whose anchor has more than one stretch send
their runs, which meet by digest. Whatever has a run is in an earlier such stretch or equal to one, so nothing is lost.

Defined cases: ids are whole numbers; null text is an empty one and loses nothing; a null id ranks last; rows equal in id and text are one document
given again, and get the same spans; documents that share an id but not a text are told apart; an empty table gives an empty result;
other columns are ignored; texts of any length are cut as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import spread
from .common import materialize
from .substrings import edges, numpy_rows, signed

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+(?=\s)|(?=\n|\Z))[^\S\n]*\n?")
_WORD = re.compile(r"\S+")
#: Words of a shingle; words hashed at once, about; the ``ord`` of a run of words.
SHINGLE, CHUNK, RUN = 8, 1 << 18, -2
_STEP, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd
DOC = ["none", "id", "t"]
ROW = "h long, c int, none boolean, id long, t long, ord int, start int, stop int, words int, sure boolean"


def units(text: str, sentences: bool = False) -> Iterator[tuple[int, int, str, int]]:
    """(start, stop, normalised, words) of every unit with a word."""
    for m in (_SENTENCE if sentences else _LINE).finditer(text):
        words = m.group().lower().split()
        if words:
            yield m.start(), m.end(), " ".join(words), len(words)


def unit_rows(batches: Iterator[pa.RecordBatch], sentences: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_())
    for b in batches:
        rows: list[tuple] = []
        seen = set()
        for none, i, t, text in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            key = (none, 0 if i is None else i, t)
            if key in seen:
                continue
            seen.add(key)
            for k, (a, z, unit, n) in enumerate(units(text or "", sentences)):
                d = xxhash.xxh3_128_intdigest(unit)
                rows.append((signed(d & (1 << 64) - 1), signed(d >> 64) >> 32, *key, k, a, z, n))
        rows.sort()
        prior = None
        sure = []
        for r in rows:
            sure.append(r[:2] == prior)
            prior = r[:2]
        cols = [*zip(*rows, strict=True), sure] if rows else [()] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefixes(words: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums before each word of hashes times powers of ``step``, and what takes the power of a place away."""
    power, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), x, np.uint64)))) for x in (step, pow(step, -1, 1 << 64)))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:-1]))), back


def rolled(words: np.ndarray, n: int, step: int) -> np.ndarray:
    """A hash of every ``n`` words in a row, by their hashes."""
    total, back = prefixes(words, step)
    return mixed((total[n:] - total[:-n]) * back[: len(words) - n + 1])


def anchors(words: np.ndarray, passage: int) -> np.ndarray:
    """The least hash of a shingle in every ``passage`` words in a row."""
    shingle = min(SHINGLE, passage)
    least, width, want = rolled(words, shingle, _STEP), 1, passage - shingle + 1
    while width < want:
        move = min(width, want - width)
        least = np.minimum(least[:-move], least[move:])
        width += move
    return least


def stretch_rows(batches: Iterator[pa.RecordBatch], passage: int) -> Iterator[pa.RecordBatch]:
    """(anchor, digest, document, first word, runs) of every stretch."""
    hashes = Hashes()

    def solve(docs: list[tuple], found: list[np.ndarray]) -> pa.RecordBatch:
        words, ends = np.concatenate(found), np.cumsum([len(x) for x in found])
        least = anchors(words, passage)
        of, at = np.repeat(np.arange(len(found)), np.diff(ends, prepend=0))[: len(least)], np.arange(len(least))
        inside = at + passage <= ends[of]
        least, of, at = least[inside], of[inside], at[inside]
        first = edges(of, least)
        runs = np.diff(first, append=len(at))
        a = at[first]
        total, back = prefixes(words, _OTHER)
        d = mixed((total[a + runs + passage - 1] - total[a]) * back[a])
        none, i, t = (np.array(x, k)[of[first]] for x, k in zip(zip(*docs, strict=True), (bool, np.int64, np.int64), strict=True))
        start = a - (ends[of[first]] - np.array([len(x) for x in found])[of[first]])
        cols = (least[first].view(np.int64), d.view(np.int64), none, i, t, start.astype(np.int32), runs.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "d", *DOC, "at", "runs"])

    docs, found, held = [], [], 0
    for b in batches:
        for none, i, t, text in zip(*(b.column(c) for c in range(4)), strict=True):
            words = (text.as_py() or "").lower().split()
            if len(words) < passage:
                continue
            docs.append((none.as_py(), i.as_py(), t.as_py()))
            found.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            held += len(words)
            if held >= CHUNK:
                yield solve(docs, found)
                docs, found, held = [], [], 0
    if docs:
        yield solve(docs, found)


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by (anchor, digest, document): those that an earlier document has (``gone``), and of others those whose anchor has several."""
    first: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        r = numpy_rows(b)
        new = np.zeros(len(r), bool)
        new[edges(r["h"], r["d"])] = True
        origin = r[DOC][np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]
        if first is not None and (int(r["h"][0]), int(r["d"][0])) == first[0]:
            origin[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(r)] = first[1]
        first = ((int(r["h"][-1]), int(r["d"][-1])), origin[-1])
        gone = r[DOC] != origin
        out = pa.RecordBatch.from_arrays([*(b.column(c) for c in (*DOC, "at", "runs")), pa.array(gone)], names=[*DOC, "at", "runs", "gone"])
        yield out.filter(pa.array(gone | r["several"]))


def run_rows(batches: Iterator[pa.RecordBatch], passage: int) -> Iterator[pa.RecordBatch]:
    """Rows of units from (document, text, stretches): what goes for certain, and the runs of the other stretches."""
    hashes = Hashes()
    names = [x.split()[0] for x in ROW.split(", ")]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        size = [len(r[3]) for r in rows]
        none, i, t = (np.repeat(np.array([r[c] for r in rows], k), size) for c, k in enumerate((bool, np.int64, np.int64)))
        h, c, start, stop, sure = (np.concatenate([r[k] for r in rows]) for k in range(3, 8))
        cols = (h, c, none, i, t, np.full(len(h), RUN, np.int32), start, stop, np.full(len(h), passage, np.int32), sure)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    rows, held = [], 0
    for b in batches:
        for none, i, t, text, given in zip(*(b.column(c) for c in range(5)), strict=True):
            text = text.as_py() or ""
            a, n, gone = (given.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "runs", "gone"))
            place = np.array([m.span() for m in _WORD.finditer(text)], np.int32)
            certain = np.zeros(len(place) + 1, bool)
            certain[spread(a[gone], a[gone] + n[gone])] = True
            bounds = np.flatnonzero(np.diff(certain, prepend=False))  # of neighbouring runs that go
            left, right = bounds[::2], bounds[1::2]
            at = np.unique(spread(a[~gone], a[~gone] + n[~gone]))
            if len(at):
                words = text.lower().split()
                x = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                h, c = rolled(x, passage, _STEP)[at].view(np.int64), (rolled(x, passage, _OTHER)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            else:
                h, c = np.zeros(0, np.int64), np.zeros(0, np.int32)
            none_known = np.zeros(len(left), np.int64)
            start, stop = np.concatenate((left, at)), np.concatenate((right - 1, at)) + passage - 1
            sure = np.arange(len(start)) < len(left)
            rows.append((none.as_py(), i.as_py(), t.as_py(), np.concatenate((none_known, h)), np.concatenate((none_known.astype(np.int32), c)), place[start, 0], place[stop, 1], sure))
            held += len(start)
            if held >= CHUNK:
                yield solve(rows)
                rows, held = [], 0
    if rows:
        yield solve(rows)


def later_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sure, digest, rank): the sure ones, and of the others all but the first of each digest that aren't of the same document and place."""
    first: tuple | None = None  # digest and document of the last run's first row
    for b in batches:
        if not b.num_rows:
            continue
        r = numpy_rows(b)
        new = np.zeros(len(r), bool)
        new[edges(r["sure"], r["h"], r["c"])] = True
        lead = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        origin = r[[*DOC, "ord"]][lead]
        if first is not None and (bool(r["sure"][0]), int(r["h"][0]), int(r["c"][0])) == first[0]:
            n = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(r)
            origin[:n] = first[1]
        gone = r["sure"] | (r[[*DOC, "ord"]] != origin)
        first = ((bool(r["sure"][-1]), int(r["h"][-1]), int(r["c"][-1])), origin[-1])
        yield b.select([*DOC, "ord", "start", "stop", "words"]).filter(pa.array(gone))


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def runs(batches: Iterator[pa.RecordBatch], min_run: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document, ord, start and stop, a row for each document with runs."""
    held = None

    def solve(r: np.ndarray) -> pa.RecordBatch:
        r = r[edges(r["none"], r["id"], r["t"], r["ord"], r["start"], r["stop"])]  # tasks may each have sent the same row
        doc = np.zeros(len(r), bool)
        doc[edges(*(r[c] for c in DOC))] = True
        new = doc.copy()
        line = r["ord"] >= 0
        far = (np.cumsum(doc) << 32) + r["stop"]  # how far a document's runs of words have come
        new[1:] |= np.where(line[1:], r["ord"][1:] != r["ord"][:-1] + 1, (np.cumsum(doc)[1:] << 32) + r["start"][1:] > np.maximum.accumulate(np.where(line, 0, far))[:-1])
        at = np.flatnonzero(new)
        words, end = np.add.reduceat(r["words"], at), np.maximum.reduceat(r["stop"], at)
        stop = np.append(at[1:], len(r))
        keep = (words >= min_run) | ~line[at]
        at, stop, end = at[keep], stop[keep], end[keep]
        start_of = edges(*(r[c][at] for c in DOC)) if len(at) else at
        ends_of = np.append(start_of[1:], len(at)) if len(at) else at
        count = np.where(line[at], stop - at, 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(r["none"][at[start_of]]),
                pa.array(r["id"][at[start_of]]),
                pa.array(r["t"][at[start_of]]),
                pa.array([int(count[a:z].sum()) for a, z in zip(start_of, ends_of, strict=True)], pa.int32()),
                pa.array([merged([[int(r["start"][i]), int(j)] for i, j in zip(at[a:z], end[a:z], strict=True)]) for a, z in zip(start_of, ends_of, strict=True)], pa.list_(pa.list_(pa.int32()))),
            ],
            names=[*DOC, "units", "spans"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        r = numpy_rows(b)
        r = r if held is None else np.concatenate([held, r])
        cut = int(edges(*(r[c] for c in DOC))[-1])
        held = r[cut:]
        if cut:
            yield solve(r[:cut])
    if held is not None:
        yield solve(held)


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: bool = False, min_run: int = 1, passage: int = 0) -> DataFrame:
    """Per row: id (long), n_chars, n_removed_units, n_removed (characters), spans: [start, stop) pairs that go, in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_ = F.col(id_col).cast("long")
    keyed = docs.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    # settled rows are spread by document, the others meet by digest
    meet = F.when(F.col("sure"), F.xxhash64(*DOC, "ord")).otherwise(F.col("h"))
    cut = keyed.mapInArrow(lambda batches: unit_rows(batches, sentences), ROW)
    if passage:
        known = materialize(keyed.mapInArrow(lambda batches: stretch_rows(batches, passage), "h long, d long, none boolean, id long, t long, at int, runs int"), "units-stretches")
        differs = F.min("none") != F.max("none")
        for c in DOC[1:]:
            differs |= F.min(c) != F.max(c)
        shared = known.groupBy("h").agg(differs.alias("differs"), (F.min("d") != F.max("d")).alias("several")).where("differs").select("h", "several")
        dealt = known.join(shared, "h").repartition("h", "d").sortWithinPartitions("h", "d", *DOC).mapInArrow(judged, "none boolean, id long, t long, at int, runs int, gone boolean")
        given = dealt.groupBy(*DOC).agg(F.collect_list(F.struct("at", "runs", "gone")).alias("stretches"))
        cut = cut.unionByName(keyed.join(given, DOC).select(*DOC, "text", "stretches").mapInArrow(lambda batches: run_rows(batches, passage), ROW))
    met = cut.repartition(meet).sortWithinPartitions("sure", "h", "c", *DOC, "ord")
    gone = met.mapInArrow(later_ones, "none boolean, id long, t long, ord int, start int, stop int, words int")
    found = gone.repartition(*DOC).sortWithinPartitions(*DOC, "ord", "start", "stop").mapInArrow(lambda batches: runs(batches, min_run), "none boolean, id long, t long, units int, spans array<array<int>>")
    rows = keyed.select(*DOC, F.length("text").cast("long").alias("n_chars"))
    return rows.join(found, DOC, "left").select(
        F.when(~F.col("none"), F.col("id")).alias(id_col),
        "n_chars",
        F.coalesce("units", F.lit(0)).alias("n_removed_units"),
        F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0]), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
    )
