"""Benchmark decontamination: whole test items found in texts within an edit budget.

Texts and items are normalised alike: lower case, white space as one space. An item of n characters may differ by
``floor(RATE * n)`` edits. It is cut into one piece more than that, so at least one piece stands in a match unchanged.

1. One Aho-Corasick automaton over all pieces finds every exact piece hit in one pass over each text.
2. Consecutive pieces form groups of at most 64 characters. By the same count, a match has a group with fewer edits than
   pieces, and in it an unchanged piece. So a hit must extend to its group within that smaller budget: Myers' bit-parallel distance, one
   machine word a pattern, many hits at a time.
3. What is left is verified by Myers' distance of the whole item, of any length, around the hit.

Neither step loses a match. Documents aren't shuffled. Items come in blocks of at most ``BLOCK_CHARS`` characters, a pass over the
documents for each, so the benchmark may be of any size and what a task holds is bounded.

Defined cases: null or empty texts match nothing, nor do items that are empty after normalising; repeated rows give repeated results; equal items
each match; empty tables give an empty result; other columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

RATE = 0.1
BLOCK_CHARS = 4_000_000
#: Hits that are extended at a time.
STEP = 1 << 15


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(size: int, rate: float) -> int:
    return int(rate * size + 1e-9)


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of the text, where that ends): bit-parallel, any length."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        eq[ch] = eq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for j, ch in enumerate(text, 1):
        e = eq.get(ch, 0)
        diagonal = (((e & up) + up) ^ up) | e | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
        if score < best:
            best, at = score, j
    return best, at


class Items:
    """The automaton of all pieces, and the group of each piece as bit masks by character."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        piece: list[tuple[int, int, int, int]] = []  # item, offset in it, group, offset in that
        groups: list[tuple[str, int]] = []  # text, edits
        for k, (_, text, edits) in enumerate(self.items):
            cuts = [j * len(text) // (edits + 1) for j in range(edits + 2)]
            first = 0
            while first <= edits:
                last = first + 1
                while last <= edits and cuts[last + 1] - cuts[first] <= 64:
                    last += 1
                whole = text[cuts[first] : cuts[last]]
                for j in range(first, last):
                    places.setdefault(text[cuts[j] : cuts[j + 1]], []).append(len(piece))
                    piece.append((k, cuts[j], len(groups), cuts[j] - cuts[first]))
                # a piece of over 64 characters stands alone: no edits, no more to check
                groups.append((whole if len(whole) <= 64 else "", last - first - 1))
                first = last
        for text, at in places.items():
            self.automaton.add_word(text, (len(text), at))
        if places:
            self.automaton.make_automaton()
        self.piece = np.array(piece, np.int64).reshape(-1, 4)
        letters = sorted({c for g, _ in groups for c in g})
        self.code = np.zeros(0x110000, np.int32)
        for i, c in enumerate(letters, 1):
            self.code[ord(c)] = i
        # masks of the letters that a group has, in order of (group, letter): 64 of a group at most
        masks: dict[int, int] = {}
        for g, (text, _) in enumerate(groups):
            for i, c in enumerate(text):
                key = g << 21 | int(self.code[ord(c)])
                masks[key] = masks.get(key, 0) | 1 << i
        self.eq_keys = np.array(sorted(masks), np.int64)
        self.eq = np.array([masks[k] for k in self.eq_keys.tolist()], np.uint64)
        self.length = np.array([len(t) for t, _ in groups], np.int64)
        self.edits = np.array([e for _, e in groups], np.int64)

    def mask(self, group: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Where each group has the letter, zero if it hasn't."""
        key = group << 21 | letter
        at = np.minimum(np.searchsorted(self.eq_keys, key), len(self.eq) - 1)
        return np.where(self.eq_keys[at] == key, self.eq[at], np.uint64(0))

    def extend(self, codes: np.ndarray, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the group of each hit (a piece that starts at ``start``) is there within its edits."""
        g, inside = self.piece[piece, 2], self.piece[piece, 3]
        m, edits = self.length[g], self.edits[g]
        ok = (edits == 0) | (m == 0)
        todo = np.flatnonzero(~ok)
        if not len(todo):
            return ok
        g, m, edits = g[todo], m[todo], edits[todo]
        at, size = start[todo] - inside[todo] - edits, m + 2 * edits
        one = np.uint64(1)
        top = (m - 1).astype(np.uint64)
        up, down = np.full(len(g), ~np.uint64(0)), np.zeros(len(g), np.uint64)
        score, best = m.copy(), m.copy()
        for j in range(int(size.max())):
            spot = at + j
            e = self.mask(g, np.where((spot >= 0) & (spot < len(codes)), codes[np.clip(spot, 0, len(codes) - 1)], 0))
            diagonal = (((e & up) + up) ^ up) | e | down
            right, left = down | ~(diagonal | up), up & diagonal
            score += ((right >> top) & one).astype(np.int64) - ((left >> top) & one).astype(np.int64)
            right, left = right << one, left << one
            up, down = left | ~(diagonal | right), right & diagonal
            np.minimum(best, score, out=best, where=j < size)
        ok[todo] = best <= edits
        return ok

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, distance) of every item within its budget; one row for a pair, with its least distance."""
        if not self.items:
            return []
        hits: list[tuple[int, int, int]] = []
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).tolist()
        for i, t in enumerate(texts):
            for end, (size, at) in self.automaton.iter(t):
                start = end - size + 1
                hits += [(i, start, p) for p in at]
        if not hits:
            return []
        codes = self.code[np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        of, start, piece = np.array(hits, np.int64).T
        base = np.array(first)[of]
        ok = np.concatenate([self.extend(codes, (start + base)[at : at + STEP], piece[at : at + STEP]) for at in range(0, len(of), STEP)])
        of, item, begin = of[ok], self.piece[piece[ok], 0], start[ok] - self.piece[piece[ok], 1]
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for i, k, b in sorted(set(zip(of.tolist(), item.tolist(), begin.tolist(), strict=True))):
            _, text, edits = self.items[k]
            a, z = max(0, b - edits), b + len(text) + edits
            runs = regions.setdefault((i, k), [])
            if runs and a <= runs[-1][1] and z - runs[-1][0] < 8 * len(text):
                runs[-1][1] = z
            else:
                runs.append([a, z])
        found = []
        for (i, k), runs in regions.items():
            _, text, edits = self.items[k]
            best = min(myers(text, texts[i][a:z])[0] for a, z in runs)
            if best <= edits:
                found.append((i, k, best))
        return found


_items: dict[str, Items] = {}


def _built(block: list[tuple[object, str]], rate: float, key: str) -> Items:
    if key not in _items:
        _items.clear()
        _items[key] = Items(block, rate)
    return _items[key]


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    block, held = [], 0
    for r in items.select(item_col, text_col).toLocalIterator():
        text = normal(r[1])
        block.append((r[0], text))
        held += len(text)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def _key(block: list[tuple[object, str]], rate: float) -> str:
    return hashlib.sha256(repr((rate, block)).encode()).hexdigest()


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    rate: float = RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item, distance) of every item that a text holds within its edit budget."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance int"
    pa_kind = to_arrow_type(items.schema[item_col].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, item_col, item_text_col):
        key = _key(block, rate)

        def run(batches: Iterator[pa.RecordBatch], block=block, key=key) -> Iterator[pa.RecordBatch]:
            table = _built(block, rate, key)
            for b in batches:
                found = table.search([normal(t) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([i for i, _, _ in found], pa.int64())),
                        pa.array([table.items[k][0] for _, k, _ in found]).cast(pa_kind),
                        pa.array([d for _, _, d in found], pa.int32()),
                    ],
                    names=[id_col, item_col, "distance"],
                )

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(run, schema))
    return out


def leaked(block: list[tuple[object, str]], rate: float):
    """A function of texts: whether they hold an item of the block."""
    key = _key(block, rate)

    def run(texts: pd.Series) -> pd.Series:
        hit = np.zeros(len(texts), bool)
        hit[[i for i, _, _ in _built(block, rate, key).search([normal(t) for t in texts])]] = True
        return pd.Series(hit)

    return F.pandas_udf(run, "boolean")


def drop_leaked(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item within its edit budget."""
    for block in item_blocks(items, item_col, item_text_col):
        docs = docs.where(~leaked(block, rate)(F.col(text_col)))
    return docs
