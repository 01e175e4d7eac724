"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, covering all of its text. A passage is encoded by the square roots of the shares of its
character classes and hashed class pairs, in 255ths, then ``h = tanh(x W + c)``. Gated attention weighs passages,
``a = softmax(w . (tanh(h V) * sigmoid(h U)))``, and the document's score is ``sigmoid(o . sum(a h) + b)``. Only documents have labels;
attention weights are learned from them, by Adam on the cross entropy.

Training is on a bounded sample: at most ``TRAIN_DOCS`` labelled documents outside the held-out part, those with the smallest
hashes of their ids, with all their passages. Of these, documents that would bring the sum of passages over ``TRAIN_PASSAGES`` are left out whole. Scoring takes every passage of every document in one pass
without a shuffle. Held out is what has crc32 of the id, as text, mod 4 equal to 2. Ids, languages, sources and labels are no inputs of a score.

Defined cases: null text is an empty one, one passage of zeros, scored like any other; a null id isn't held out; several labels of an id
are averaged; with no labels, or labels of one kind, every score is the smoothed share of label 1; repeated
rows are rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

PASSAGE, THRESHOLD = 512, 0.7
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 96_000
CLASSES, PAIRS, HIDDEN, GATE, EPOCHS = 64, 256, 24, 12, 40
WIDTH = CLASSES + PAIRS
_STRIDE = 2048


def _fold() -> np.ndarray:
    """Bytes to classes: letters by themselves in lower case, upper case, digits, marks by themselves, parts of longer characters."""
    fold = np.zeros(256, np.int64)
    for i in range(26):
        fold[ord("a") + i] = 1 + i
        fold[ord("A") + i] = 27
    fold[ord("0") : ord("9") + 1] = 28
    fold[0x80:0xC0], fold[0xC0:] = 29, 30
    at = 31
    for i in range(128):
        if fold[i] == 0 and i >= 32:
            fold[i] = min(at, 63)
            at += 1
    return fold


_FOLD = _fold()
_PAIR = CLASSES + (np.arange(CLASSES * CLASSES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64) % PAIRS


def passages(text: bytes) -> Iterator[np.ndarray]:
    """Encodings of all passages in 255ths, ``_STRIDE`` at a time; training and scoring see the same."""
    if not text:
        yield np.zeros((1, WIDTH), np.uint8)
    for at in range(0, len(text), PASSAGE * _STRIDE):
        c = _FOLD[np.frombuffer(text, np.uint8, min(PASSAGE * _STRIDE, len(text) - at), at)]
        n = -(-len(c) // PASSAGE)
        base = np.arange(len(c)) // PASSAGE * WIDTH
        counts = np.bincount(base + c, minlength=n * WIDTH)
        pairs = base[1:] + _PAIR[c[:-1] * CLASSES + c[1:]]
        counts += np.bincount(np.delete(pairs, np.s_[PASSAGE - 1 :: PASSAGE]), minlength=n * WIDTH)  # not those across passages
        size = np.full((n, 1), PASSAGE)
        size[-1] = len(c) - (n - 1) * PASSAGE
        yield np.rint(255 * np.sqrt(counts.reshape(n, WIDTH) / size)).clip(0, 255).astype(np.uint8)


def inputs(codes: np.ndarray) -> np.ndarray:
    """The model's inputs, from 0 to 1."""
    return codes.astype(np.float32) / np.float32(255)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "W": r.normal(0, 1 / np.sqrt(WIDTH) * 3, (WIDTH, HIDDEN)),
            "c": np.zeros(HIDDEN),
            "V": r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "U": r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "w": r.normal(0, 1 / np.sqrt(GATE), GATE),
            "o": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "b": np.zeros(1),
        }

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages' representations and attention logits."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["c"])
        return h, (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]

    def score(self, text: bytes) -> float:
        h, e = (np.concatenate(x) for x in zip(*(self.encode(inputs(x)) for x in passages(text)), strict=True))
        a = np.exp(e - e.max())
        return float(sigmoid((a / a.sum()) @ h @ self.p["o"] + self.p["b"][0]))

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """``first``: where each document's passages start."""
        p = self.p
        doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ p["W"] + p["c"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a /= np.add.reduceat(a, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first)
        d = (sigmoid(z @ p["o"] + p["b"][0]) - y) / len(y)
        dz = d[:, None] * p["o"]
        da = np.einsum("ij,ij->i", dz[doc], h)
        de = a * (da - np.add.reduceat(a * da, first)[doc])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz[doc] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "c": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "o": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> None:
        r = np.random.default_rng(1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                sizes = np.array([len(bags[i]) for i in part])
                g = self.gradients(np.concatenate([bags[i] for i in part]), np.cumsum(sizes) - sizes, labels[part])
                step += 1
                for k, x in self.p.items():
                    d = g[k] + 1e-5 * x
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    x -= rate * 0.5 ** (3 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


class Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, text: bytes) -> float:
        return self.share


def held_out(id_col: F.Column) -> F.Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES):
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(id_col)
        .agg(F.avg(label_col).alias("y"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(train_docs)
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = []
            for text in b.column(2):
                bags.append(b"".join(x.tobytes() for x in passages((text.as_py() or "").encode())))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(bags, pa.binary())], names=["id", "y", "bag"])

    # ``train_docs`` rows at most are broadcast; a repeated id gives one text
    held = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.first("y").alias("y"), F.min(text_col).alias("text"))
    size = F.greatest(F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / PASSAGE), F.lit(1))
    total, beyond = 0, []
    for h, n in sorted(map(tuple, held.select(F.xxhash64(id_col), size).collect())):
        if total + n > train_passages:
            beyond.append(h)
        else:
            total += n
    if beyond:
        held = held.where(~F.xxhash64(id_col).isin(beyond))
    rows = sorted(held.select(id_col, "y", "text").mapInArrow(encode, "id string, y double, bag binary").collect(), key=lambda r: r["id"])
    y = np.array([r["y"] for r in rows])
    if len(rows) == 0 or y.min() == y.max():
        return Constant(float((y.sum() + 1) / (len(y) + 2)))
    model = Attention()
    model.fit([inputs(np.frombuffer(r["bag"], np.uint8).reshape(-1, WIDTH)) for r in rows], y)
    return model


def with_score(docs: DataFrame, model, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of every row."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = kept.schema.add(score_col, "double")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score((t.as_py() or "").encode()) for t in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(scores, pa.float64())], names=[*keep, score_col])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(free_name(docs, "text"))).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, label_col)
    scored = with_score(docs, model, [id_col], text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``."""
    model = train(docs, labels, id_col, text_col, label_col)
    score = free_name(docs, "score")
    scored = with_score(docs, model, docs.columns, text_col, score)
    return scored.where(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
