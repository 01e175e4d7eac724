"""Exact BM25 top-k by block-max WAND over inverted indexes in shards, merged by global statistics.

1. A shard is a run of about ``SHARD_BYTES`` of text of one input split, indexed where it is read: texts aren't shuffled. Its index has
   the terms in order of their 64-bit digests; for each, its postings, cut at blocks of ``BLOCK`` documents (documents that share
   their commonest word stand together). Equal texts of a shard are one document with several ids.
2. Document frequencies are summed over shards, the number and mean length of documents likewise: every shard scores with the same numbers.
3. Queries' terms get their weights by a join with these frequencies, equal texts once. A query is first run in one shard; the k-th best
   score found there is a threshold to begin with in all others.
4. In a shard, term bounds (a term's weight by its greatest impact) and block bounds (by the greatest impact in the block) prune
   as in block-max WAND, for all documents of the shard and a block of queries at once. Queries whose term bounds stay below their threshold are done with.
   The cursors of terms that are rare in a band (``BAND`` documents that stand together) are moved first. Then a document can be a pivot only if what it has so far
   and the block bounds of the common terms reach the threshold: blocks without such documents are skipped. In the others
   the impacts of the common terms, which a band keeps as columns, are added for all queries that need the block by one product of matrices.
   These sums are in single precision; documents that with its error (``ERROR``) can reach the threshold and the k-th best here are
   scored in full, in double precision, and the threshold is raised.
   Shards are files in the shared folder, and so are queries: where Python can open that folder, each task reads its shards and its queries from
   there, and an index passes through a JVM once, when it is written. Else indexes and queries are shuffled.
5. A task has a part of the queries and one of ``GROUPS`` groups of the shards, one shard after another, and gives the k best of the group for each query;
   the k best of those are kept. So what is there before this merge grows as the queries do, however many shards there are.

Scores are compared as rounded to six digits; a bound prunes only if it is lower than the threshold by more than that. Equal scores rank by id.
The query set is stated: rows whose id is divisible by ``EVERY``, their whole texts, against all rows. Ids are whole numbers.

Defined cases: null and empty texts are in the index but have no terms, so they are never found and find nothing; null ids aren't
queries, but are found, after all others of their score; repeated rows count and are found as often as they are there, but
ask once; a text larger than a shard is a shard; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import can_open_shared, materialize, open_shared

K, EVERY, K1, B = 10, 20, 1.2, 0.75
BLOCK, SHARD_BYTES, QUERIES = 64, 16 << 20, 500
#: Documents that stand together are a band; its columns are terms of which the share in the band by that in the shard is larger than ``COMMON``, the ``COLUMNS`` most frequent.
BAND, COMMON, COLUMNS = 8 * BLOCK, 0.0008, 1024
#: Sums that are held at a time while postings are added up.
CELLS = 1 << 16
#: Queries for which documents are scored in full at a time.
LANES = 8
#: A task runs about ``PART_QUERIES`` queries at most in one of ``GROUPS`` groups of shards, so a query's results before the merge are at most ``GROUPS`` x k.
PART_QUERIES, GROUPS = 8_000, 4
#: More than rounding moves a score.
SLACK = 2e-6
#: A larger share of a sum than single precision moves it.
ERROR = 1e-4


def terms(text: str | None) -> Counter:
    return Counter((text or "").lower().split())


def digests(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64)


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


class Builder:
    """Takes rows, keeps their digested terms, gives the index of a shard."""

    def __init__(self):
        self.made: list[tuple[str, np.ndarray, np.ndarray]] = []  # commonest word, terms, times
        self.ids: list[list[int | None]] = []
        self.known: dict[bytes, int] = {}
        self.rows = self.words = self.size = 0

    def add(self, id_: int | None, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        at = self.known.setdefault(hashlib.sha256(raw).digest(), len(self.made))
        self.size += len(raw)
        self.rows += 1
        if at == len(self.made):
            bag = terms(text)
            most = max(bag.values(), default=0)
            self.made.append((max((w for w, times in bag.items() if times == most), default=""), digests(bag), np.fromiter(bag.values(), np.int32, len(bag))))
            self.ids.append([])
        self.ids[at].append(id_)
        self.words += int(self.made[at][2].sum())

    def index(self) -> dict[str, np.ndarray]:
        """Postings sorted by (term, document)."""
        order = sorted(range(len(self.made)), key=lambda i: (self.made[i][0], i))
        size = [len(self.made[i][1]) for i in order]
        doc = np.repeat(np.arange(len(order), dtype=np.int32), size)
        term = np.concatenate([self.made[i][1] for i in order]) if order else np.empty(0, np.uint64)
        tf = np.concatenate([self.made[i][2] for i in order]) if order else np.empty(0, np.int32)
        by = np.argsort(term, kind="stable")
        term, doc, tf = term[by], doc[by], tf[by]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
        ids = [x for i in order for x in self.ids[i]]
        return {
            "ids": np.array([-1 if x is None else x for x in ids], np.int64),
            "null": np.array([x is None for x in ids], bool),
            "copies": np.array([len(self.ids[i]) for i in order], np.int64),
            "length": np.array([int(self.made[i][2].sum()) for i in order], np.int64),
            "term": term[first],
            "first": np.append(first, len(term)).astype(np.int64),
            "doc": doc,
            "tf": tf,
        }


def build(ids: list[int | None], texts: list[str | None]) -> dict[str, np.ndarray]:
    made = Builder()
    for i, t in zip(ids, texts, strict=True):
        made.add(i, t or "")
    return made.index()


class Shard:
    def __init__(self, index: dict[str, np.ndarray], mean: float):
        self.ids, self.null, self.term, self.first, doc = (index[k] for k in ("ids", "null", "term", "first", "doc"))
        self.row = np.concatenate(([0], np.cumsum(index["copies"])))
        self.docs = len(index["length"])
        self.blocks = -(-self.docs // BLOCK)
        self.norm = K1 * (1 - B + B * index["length"] / max(mean, 1e-9))
        tf, norm = index["tf"].astype(np.float32), self.norm.astype(np.float32)
        impact = tf * np.float32(K1 + 1)
        impact /= tf + norm[doc]
        del tf
        self.term_most = np.maximum.reduceat(impact, self.first[:-1]) if len(self.term) else np.empty(0, np.float32)
        # a term that is common in a band has its impacts there as a column, and the greatest of each block, not as postings
        band = doc // BAND
        new = np.zeros(len(doc) + 1, bool)
        new[self.first] = True
        new[1:-1] |= band[1:] != band[:-1]
        cell = np.flatnonzero(new)
        size = np.diff(cell)
        cell_term, cell_band = np.repeat(np.arange(len(self.term), dtype=np.int32), np.diff(np.searchsorted(cell, self.first))), band[cell[:-1]]
        del band, new
        share = np.diff(self.first)[cell_term] / max(self.docs, 1)  # about that of the queries that have the term
        common = (size * share > COMMON * BAND) & (size > 4)
        bands = -(-self.docs // BAND)
        for b in np.flatnonzero(np.bincount(cell_band[common], minlength=bands) > COLUMNS).tolist():
            here = np.flatnonzero(common & (cell_band == b))
            common[here[np.argsort(-size[here], kind="stable")[COLUMNS:]]] = False
        columns_at = np.flatnonzero(common)
        some = np.unique(cell_term[columns_at])
        self.common = np.full(len(self.term), -1, np.int32)
        self.common[some] = np.arange(len(some))
        self.column = np.full((bands, len(some)), -1, np.int32)
        self.columns: list[np.ndarray] = []
        self.columns_most: list[np.ndarray] = []
        for b in range(bands):
            here = columns_at[cell_band[columns_at] == b]
            self.column[b, self.common[cell_term[here]]] = np.arange(len(here))
            posts = spread(cell[here], cell[here + 1])
            columns = np.zeros((min(BAND, self.blocks * BLOCK - b * BAND), len(here)), np.float32)
            columns[doc[posts] - b * BAND, np.repeat(np.arange(len(here)), size[here])] = impact[posts]
            self.columns.append(columns)
            self.columns_most.append(columns.reshape(len(columns) // BLOCK, BLOCK, len(here)).max(1))
        posts = ~np.repeat(common, size)
        self.rare_doc, self.rare_impact = doc[posts], impact[posts]
        self.rare_first = np.concatenate(([0], np.cumsum(posts)))[self.first]
        # the same postings by document, terms in order
        del cell, cell_term, cell_band, size, share, common, posts, impact
        by = np.argsort(doc.astype(np.uint16) if self.docs <= 1 << 16 else doc, kind="stable")
        self.doc_term = np.repeat(np.arange(len(self.term), dtype=np.int32), np.diff(self.first))[by]
        self.doc_tf = index["tf"][by]
        self.doc_first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=self.docs)))) if len(doc) else np.zeros(self.docs + 1, np.int64)
        self.weight = np.zeros(LANES * len(self.term))

    def full(self, docs: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """Scores by the weights that are set in each one's lane, of documents that have terms. Terms are in order, so that equal documents add up alike in every shard."""
        a, z = self.doc_first[docs], self.doc_first[docs + 1]
        at = spread(a, z)
        weight = self.weight[self.doc_term[at] + np.repeat(lane * len(self.term), z - a)]
        hit = np.flatnonzero(weight)
        of = np.repeat(np.arange(len(docs)), z - a)[hit]
        tf = self.doc_tf[at[hit]]
        return np.round(np.bincount(of, weight[hit] * (tf * (K1 + 1) / (tf + self.norm[docs[of]])), len(docs)), 6)

    def top(self, term: np.ndarray, weight: np.ndarray, k: int, threshold: float = 0.0) -> list[tuple[int | None, float]]:
        """The best (id, score), at most ``k``, of those that reach ``threshold``."""
        asked = Asked(np.zeros((1, 32), np.uint8), np.array([0, len(term)]), term, weight, np.array([threshold]))
        self.ask(asked, k)
        return [(None if null else i, -s) for s, null, i in asked.best[0]]

    def ask(self, asked: Asked, k: int) -> None:
        """Put what this shard has for the queries among the best of each, and raise their thresholds."""
        if not len(self.term) or not len(asked.term):
            return
        at = np.minimum(np.searchsorted(self.term, asked.words), len(self.term) - 1)
        at = np.where(self.term[at] == asked.words, at, -1)[asked.word]
        hit = np.flatnonzero(at >= 0)
        at, of, weight = at[hit], asked.of[hit], asked.weight[hit].astype(np.float32)
        # term bounds: queries that no document of the shard can match well enough
        able = np.bincount(of, weight * self.term_most[at], asked.count) * (1 + ERROR) >= np.maximum(asked.threshold - SLACK, 0)
        able &= np.bincount(of, minlength=asked.count) > 0
        who = np.flatnonzero(able)
        if not len(who):
            return
        new = np.cumsum(able) - 1
        keep = able[of]
        hit, at, of, weight = hit[keep], at[keep], new[of[keep]], weight[keep]
        least = asked.threshold[who] - SLACK
        # the cursors of terms that are rare in a band are moved there, some queries at a time
        width = self.blocks * BLOCK
        score = np.zeros((len(who), width), np.float32)
        size = self.rare_first[at + 1] - self.rare_first[at]
        rare = np.flatnonzero(size)
        size, rare_at, rare_of, rare_weight = size[rare], self.rare_first[at[rare]], of[rare], weight[rare].astype(np.float64)
        start = np.searchsorted(rare_of, np.arange(len(who) + 1))
        step = max(1, CELLS // width)
        for q in range(0, len(who), step):
            now = slice(start[q], start[min(q + step, len(who))])
            posts = spread(rare_at[now], rare_at[now] + size[now])
            place = self.rare_doc[posts] + np.repeat((rare_of[now] - q) * width, size[now])
            part = score[q : q + step]
            part += np.bincount(place, np.repeat(rare_weight[now], size[now]) * self.rare_impact[posts], part.size).reshape(part.shape)
        rare_most = score.reshape(len(who), self.blocks, BLOCK).max(2)
        # block bounds of the common terms: blocks in which no document can be a pivot are skipped, in the others the impacts are added
        common = np.flatnonzero(self.common[at] >= 0)
        common_at, common_of, common_weight = self.common[at[common]], of[common], weight[common]
        for b, (columns, most) in enumerate(zip(self.columns, self.columns_most, strict=True)):
            column = self.column[b, common_at]
            have = np.flatnonzero(column >= 0)
            given = np.zeros((len(who), columns.shape[1]), np.float32)
            given[common_of[have], column[have]] = common_weight[have]
            here = score[:, b * BAND : b * BAND + len(columns)]
            bound = rare_most[:, b * (BAND // BLOCK) : (b + 1) * (BAND // BLOCK)] + given @ most.T
            live = (bound * (1 + ERROR) >= least[:, None]) & (bound > 0)
            any_ = np.flatnonzero(live.any(1))
            given, live = given[any_], live[any_]
            for c in np.flatnonzero(live.any(0)).tolist():
                docs, q = slice(c * BLOCK, c * BLOCK + BLOCK), np.flatnonzero(live[:, c])
                if 2 * len(q) > len(any_):
                    here[any_, docs] += given @ columns[docs].T  # what the others get is no more than they have
                else:
                    here[any_[q], docs] += given[q] @ columns[docs].T
        # candidates: what can reach the threshold, and the k-th best here; only they are scored in full
        least = np.maximum(least * (1 - 2 * ERROR), np.finfo(np.float32).tiny).astype(np.float32)
        able = np.flatnonzero(score.max(1) >= least)
        start = np.searchsorted(of, np.arange(len(who) + 1))
        for s in range(0, len(able), LANES):
            some = able[s : s + LANES].tolist()
            maybe = [np.flatnonzero(score[i] >= least[i]) for i in some]
            for n, (i, docs) in enumerate(zip(some, maybe, strict=True)):
                if len(docs) > k:
                    have = score[i, docs]
                    maybe[n] = docs[have * (1 + ERROR) >= np.partition(have, -k)[-k] * (1 - ERROR) - SLACK]
            mine = [slice(start[i], start[i + 1]) for i in some]
            set_ = np.concatenate([at[m] + n * len(self.term) for n, m in enumerate(mine)])
            self.weight[set_] = np.concatenate([asked.weight[hit[m]] for m in mine])
            docs, lane = np.concatenate(maybe), np.repeat(np.arange(len(some)), [len(x) for x in maybe])
            found = self.full(docs, lane)
            self.weight[set_] = 0
            take = np.flatnonzero(found >= asked.threshold[who[some]][lane])
            for n, d, x in zip(lane[take].tolist(), docs[take].tolist(), found[take].tolist(), strict=True):
                rows = range(self.row[d], self.row[d + 1])
                asked.best[who[some[n]]] += sorted((-x, bool(self.null[r]), int(self.ids[r])) for r in rows)[:k]
            for q in who[some].tolist():
                best = asked.best[q]
                best.sort()
                del best[k:]
                if len(best) == k:
                    asked.threshold[q] = max(asked.threshold[q], -best[-1][0])


class Asked:
    """A block of queries: where each one's terms start, the terms in order, their weights, thresholds, and the best (-score, id is null, id) so far."""

    def __init__(self, key: np.ndarray, first: np.ndarray, term: np.ndarray, weight: np.ndarray, threshold: np.ndarray):
        self.key, self.first, self.term, self.weight, self.threshold = key, first, term, weight, threshold
        self.count = len(first) - 1
        self.of = np.repeat(np.arange(self.count), np.diff(first))
        self.words, self.word = np.unique(term, return_inverse=True)
        self.best: list[list[tuple[float, bool, int]]] = [[] for _ in range(self.count)]


def spread(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """All indices in the ranges [a, z), one after another."""
    n = z - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def index_rows(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Shards from (id, text), as they come."""

    def done(made: Builder) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([made.rows], pa.int64()), pa.array([made.words], pa.int64()), pa.array([dump(**made.index())], pa.binary())], names=["n", "words", "blob"]
        )

    made = Builder()
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            if made.size >= shard_bytes:
                yield done(made)
                made = Builder()
            made.add(i.as_py(), t.as_py())
    if made.rows:
        yield done(made)


def blobs(path: str) -> Iterator[dict[str, np.ndarray]]:
    """What the rows of a file of the shared folder hold, a row at a time."""
    with open_shared(path) as f:
        rows = parquet.ParquetFile(f).iter_batches(1, columns=["blob"])
        while b := next(rows, None):
            kept = [load(b.column(0)[0].as_py())]
            del b
            pa.default_memory_pool().release_unused()
            yield kept.pop()


def by_size(paths: list[str]) -> list[str]:
    """The largest first, so that groups of every n-th are about equal."""

    def size(path: str) -> int:
        with open_shared(path) as f:
            return f.size()

    return sorted(paths, key=lambda path: (-size(path), path))


def frequency(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    copies = np.concatenate(([0], np.cumsum(x["copies"][x["doc"]])))
    return pa.RecordBatch.from_arrays([pa.array(x["term"].view(np.int64)), pa.array(np.diff(copies[x["first"]]))], names=["term", "df"])


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column(0):
            yield frequency(load(blob.as_py()))


def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term, tf) of (key, text)."""
    for b in batches:
        for key, text in zip(b.column(0), b.column(1), strict=True):
            bag = terms(text.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([key.as_py()] * len(bag), pa.binary()), pa.array(digests(bag).view(np.int64)), pa.array(np.fromiter(bag.values(), np.int32, len(bag)))], names=["key", "term", "tf"]
            )


def query_block(table: pa.Table) -> pa.Table:
    """The queries of a block: their keys, where each one's terms start, the terms in order, the weights, and thresholds of zero."""
    place: dict[bytes, int] = {}
    of = np.fromiter((place.setdefault(x.as_py(), len(place)) for x in table.column("key")), np.int64, table.num_rows)
    names = list(place)
    term, weight = table.column("term").to_numpy().view(np.uint64), table.column("weight").to_numpy()
    order = np.lexsort((term, of))
    first = np.searchsorted(of[order], np.arange(len(names) + 1))
    blob = dump(key=np.frombuffer(b"".join(names), np.uint8).reshape(-1, 32), first=first, term=term[order], weight=weight[order], threshold=np.zeros(len(names)))
    return pa.table({"qblock": table.column("qblock").slice(0, 1), "blob": pa.array([blob], pa.binary())})


def search(docs: DataFrame, k: int = K, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank from 1, doc_id, score) of the k best rows for each query."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    made = rows.mapInArrow(lambda batches: index_rows(batches, shard_bytes), "n long, words long, blob binary").withColumn("at", F.monotonically_increasing_id())
    made = materialize(made, "bm25-shards", rows_per_file=1)
    shards, n, words = made.agg(F.count("*"), F.sum("n"), F.sum("words")).first()
    n, mean, shards = n or 0, (words or 0) / max(n or 0, 1), max(shards, 1)
    opens = can_open_shared(spark)
    indexes = by_size(made.inputFiles()) if opens else []  # one without rows may be among them

    def frequencies_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from map(frequency, blobs(indexes[i]))

    if indexes:
        found = spark.range(0, len(indexes), 1, len(indexes)).mapInArrow(frequencies_of_files, "term long, df long")
    else:
        found = made.select("blob").mapInArrow(frequencies, "term long, df long")
    df = found.groupBy("term").agg(F.sum("df").alias("df"))

    asked = rows.where(F.col("id") % every == 0).select("id", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    texts = materialize(asked.groupBy("key").agg(F.first("text").alias("text")), "bm25-texts")
    count = max(1, -(-texts.count() // QUERIES))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = (
        texts.mapInArrow(query_terms, "key binary, term long, tf int")
        .join(df.hint("merge"), "term")  # its size can't be guessed from a range of file numbers
        .select("key", "term", (F.col("tf") * idf).alias("weight"), F.pmod(F.xxhash64("key"), F.lit(count)).cast("int").alias("qblock"))
    )
    blocks = materialize(weighed.groupBy("qblock").applyInArrow(query_block, "qblock int, blob binary"), "bm25-queries")

    def begin(held: Shard, q: int, x: dict[str, np.ndarray]) -> pa.RecordBatch:
        asked = Asked(**x)
        held.ask(asked, k)
        return pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([dump(**x)], pa.binary())], names=["qblock", "blob"])

    def finish(blocks: list[Asked], indexes: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The best of all these shards for each query: what one shard gives raises the thresholds in the next."""
        held = index = None
        while blocks and (index := next(indexes, None)) is not None:
            held, index = Shard(index, mean), None
            for asked in blocks:
                held.ask(asked, k)
            held = None  # a shard at a time is in memory
        for asked in blocks:
            out = [(asked.key[i].tobytes(), None if null else d, -s) for i, best in enumerate(asked.best) for s, null, d in best]
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.float64()), strict=True)], names=["key", "doc", "score"])

    # a task has a part of the queries and a group of the shards; there are always as many groups, so its results grow as the queries do
    groups = min(GROUPS, shards)
    parts = min(count, max(-(-count * QUERIES // PART_QUERIES), -(-2 * spark.sparkContext.defaultParallelism // groups)))
    cells = groups * parts
    answers, started = "key binary, doc long, score double", "qblock int, blob binary"
    if indexes:

        def begin_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for b in batches:
                for s, q, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if s != at:
                        at, held = s, None  # a shard at a time is in memory
                        held = next((Shard(x, mean) for x in blobs(indexes[s])), None)
                    yield begin(held or Shard(build([], []), mean), q, load(blob.as_py()))

        def finish_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    mine = [Asked(**x) for path in files[i % parts :: parts] for x in blobs(path)]
                    yield from finish(mine, (x for path in indexes[i // parts :: groups] for x in blobs(path)))

        at = F.pmod("qblock", F.lit(len(indexes))).cast("int").alias("at")
        firsts = blocks.select(at, "qblock", "blob").repartitionById(len(indexes), "at").sortWithinPartitions("at", "qblock")
        # the queries' files, a block each, are read where shards are: nothing is sent to every shard by a shuffle
        files = sorted(materialize(firsts.mapInArrow(begin_files, started), "bm25-started", rows_per_file=1).inputFiles())
        found = spark.range(0, cells, 1, cells).mapInArrow(finish_files, answers)
    else:
        number = Window.orderBy("at")  # a number a shard
        names = materialize(made.select("at").withColumn("shard", (F.row_number().over(number) - 1).cast("int")), "bm25-names")
        table = made.join(names, "at").select("shard", "blob")
        every_part, every_group = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (parts, groups))

        def together(to: int, queries: DataFrame, texts: DataFrame) -> DataFrame:
            """(cell, qblock, shard, blob) of a cell in one task, in order; queries have no shard, and shards no query block."""
            return (
                queries.select("cell", "qblock", F.lit(-1).alias("shard"), "blob")
                .unionByName(texts.select("cell", F.lit(-1).alias("qblock"), "shard", "blob"))
                .repartitionById(to, "cell")
                .sortWithinPartitions("cell", "shard", "qblock")
            )

        def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, dict]], Iterator[dict]]]:
            """For each cell its queries, held, and its shards, as they come."""
            rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(3)[i].as_py()) for b in batches for i in range(b.num_rows))
            for _, cell in groupby(rows, key=lambda r: r[0]):
                queries: list[tuple[int, dict]] = []
                first = None
                for _, q, blob in cell:
                    if q < 0:
                        first = blob
                        break
                    queries.append((q, load(blob)))
                yield queries, (load(x) for x in chain([] if first is None else [first], (blob for _, _, blob in cell)))

        def begin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for queries, texts in cells_of(batches):
                held = next((Shard(x, mean) for x in texts), None) or Shard(build([], []), mean)
                yield from (begin(held, q, x) for q, x in queries)

        def finish_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for queries, texts in cells_of(batches):
                yield from finish([Asked(**x) for _, x in queries], texts)

        firsts = blocks.withColumn("cell", F.pmod("qblock", F.lit(shards)).cast("int"))
        begun = together(shards, firsts, table.withColumn("cell", F.col("shard"))).mapInArrow(begin_rows, started)
        begun = materialize(begun, "bm25-started")
        queries = begun.withColumn("g", every_group).withColumn("cell", (F.col("g") * parts + F.pmod("qblock", F.lit(parts))).cast("int"))
        texts = table.withColumn("p", every_part).withColumn("cell", (F.pmod("shard", F.lit(groups)) * parts + F.col("p")).cast("int"))
        found = together(cells, queries, texts).mapInArrow(finish_rows, answers)
    found = materialize(found, "bm25-found")
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc"))  # groups x k rows
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return asked.select(F.col("id").alias("query_id"), "key").distinct().join(top, "key").select("query_id", "rank", F.col("doc").alias(id_col), "score")
