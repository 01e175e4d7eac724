"""Packing of tokenised documents into sequences by the sum-of-squares rule.

1. One pass tokenises every text. The tokenizer drops white space and never joins across it, so a text's ids are
   those of its chunks between ASCII white space in order; chunks repeat, so their ids are kept in a bounded table.
   A document's ids are followed by id 1; only documents longer than a sequence are cut. Texts don't go further: the
   slim table of pieces (id, number, start, length, CRC of the ids) is written.
2. Pieces are dealt evenly to tasks of about ``GROUP`` pieces. Each packs its own: pieces in falling order of length,
   each placed where the sum over gaps of the squared number of open bins with that gap becomes smallest (full bins don't
   count). A new bin is one of the choices until there are as many as the sum of lengths needs in any case; then only a piece that
   fits nowhere opens one. What a task can lose is a few bins in tens of thousands.

Defined cases: a null text is an empty one, one piece that holds id 1; repeated rows are rows; an empty table
gives an empty result; other columns are ignored; a text of any length is tokenised whole.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import materialize

CAPACITY, END_ID, GROUP = 4096, 1, 200_000
#: Chunks, and lower-case parts of chunks, whose ids a worker keeps, at most (about 200 MB); then the table starts anew.
KEPT, KEPT_PARTS = 500_000, 300_000


class Chunks(dict):
    """Ids of chunks, made when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        ids = self.encode(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


# The settings of the one tokenizer file whose texts may be taken apart into chunks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def splits_at_space(path: str) -> bool:
    """Whether the file's settings are those that ``ChunkTokenizer`` takes apart."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before = told.get("pre_tokenizer") or {}
    split, as_bytes = (before.get("pretokenizers") or [{}, {}])[:2] if len(before.get("pretokenizers") or []) == 2 else ({}, {})
    return (
        (told.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and split.get("pattern") == {"Regex": PATTERN}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and (as_bytes.get("type"), as_bytes.get("add_prefix_space"), as_bytes.get("use_regex")) == ("ByteLevel", False, False)
        and (told["model"].get("type"), told["model"].get("dropout")) == ("BPE", None)
        and all(t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) and not t["lstrip"] and not t["rstrip"] for t in told["added_tokens"])
    )


class ChunkTokenizer:
    """Ids of a text as little-endian 32-bit bytes, exactly as the tokenizer file gives them. Texts of other files than those known are encoded whole."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.by_chunk = splits_at_space(path)
        self.tokens = self.whole.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(33, 256) if not chr(i).isspace()}
        self.split = regex.compile(PATTERN).findall
        self.plain = regex.compile(r"[\x21-\x7e\xa1-\xff]+").fullmatch
        self.parts: dict[str, bytes] = {}
        self.chunks = Chunks(self._encode)

    def _part(self, part: str) -> bytes:
        if len(self.parts) >= KEPT_PARTS:
            self.parts.clear()
        shown = part if part.isascii() else part.translate(self.shown)
        ids = self.parts[part] = struct.pack(f"<{len(found := self.tokens(shown))}I", *[x.id for x in found])
        return ids

    def _encode(self, chunk: bytes) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # one part, as most are
            part = chunk.decode().lower()
            return self.parts.get(part) or self._part(part)
        text = chunk.decode("utf-8", "replace")
        if "<|" in text or not self.plain(text):  # may hold a special token, or needs the normaliser
            return self._whole(chunk)
        return b"".join([self.parts.get(part) or self._part(part) for part in self.split(text.lower())])

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        if not self.by_chunk:
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            row, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = memoryview(tok.ids(text.as_py() or b"") + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["id", "piece", "start", "length", "crc"],
            )

    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long")


class Bins:
    """Open bins by gap. ``least``: so many bins are needed in any case."""

    def __init__(self, capacity: int, least: int = 1 << 62):
        self.capacity, self.least = capacity, least
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, np.int64)
        self.members: list[list[int]] = []

    def put(self, item: int, size: int, gap: int) -> None:
        """Into an open bin with this gap; ``capacity`` means a new bin."""
        if gap == self.capacity:
            bin_ = len(self.members)
            self.members.append([])
        else:
            bin_ = self.open[gap].pop()
            self.count[gap] -= 1
        self.members[bin_].append(item)
        if left := gap - size:
            self.open[left].append(bin_)
            self.count[left] += 1

    def best_gap(self, size: int) -> int:
        """The gap to place ``size`` in so that the sum of squared counts becomes smallest; ties: the tightest."""
        n, c = self.count, self.capacity
        after = n[: c - size + 1].copy()  # open bins with the gap that is left
        after[0] = -1  # filling a bin adds nothing: 2 * (n[0] + 1) is not paid
        # from gap g: (n[g]-1)^2 - n[g]^2 + (n[g-size]+1)^2 - n[g-size]^2 = 2 (n[g-size] - n[g] + 1)
        cost = 2 * (after - n[size:] + 1)
        cost[0] += 1
        cost[n[size:] == 0] = np.iinfo(np.int64).max
        # a new bin; from ``least`` bins on one more is waste, so that only what fits nowhere opens one
        worst = np.iinfo(np.int64).max
        if len(self.members) < self.least or (c > size and cost[: c - size].min() == worst):
            cost[c - size] = 2 * after[c - size] + 1
        return size + int(np.argmin(cost))


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    bins = Bins(capacity, -(-int(lengths.sum()) // capacity))
    order = np.argsort(-lengths, kind="stable")
    for i in order.tolist():
        size = int(lengths[i])
        bins.put(i, size, bins.best_gap(size))
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for b, held in enumerate(bins.members):
        at = 0
        for i in held:
            bin_of[i], offset[i] = b, at
            at += int(lengths[i])
    return bin_of, offset


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    table = materialize(pieces(docs, id_col, text_col, str(path), capacity), "pack-pieces")
    kind = table.schema["id"].dataType.simpleString()
    tasks = max(1, -(-table.count() // GROUP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held)
        bin_of, offset = pack(whole.column("length").to_numpy(), capacity)
        first = TaskContext.get().partitionId() << 40
        out = whole.append_column("sequence_id", pa.array(bin_of + first)).append_column("offset", pa.array(offset))
        yield from out.to_batches()

    packed = table.repartition(tasks).mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long, sequence_id long, offset long")
    return packed.withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})
