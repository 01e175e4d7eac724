"""URL filter: a sorted array of 64-bit digests, memory-mapped, probed by vectorised binary search.

A rule is a host and the start of a path. It fits its host and all of the host's subdomains if the URL's
path starts with the rule's path; of the rules that fit, the longest text wins (ties: the longer host).

The list, Python pairs or a DataFrame, is sorted by Spark and written once to the shared folder as a few flat files (digests in
ascending order; for each digest the place, length and verdict of its rule's text; the texts), which every executor
gets by ``SparkContext.addFile``. Each Python worker maps its copy; pages of them are loaded as probed, so the list needn't fit in memory. Every URL yields the texts
that a fitting rule could have: its host's suffixes that have as many labels as some rule's host, joined to
the starts of its path that are as long as such a rule's path. Their XXH64 digests are searched in one
``numpy.searchsorted`` call for a batch, and each digest found is confirmed on the stored text, since digests can
collide. There is no shuffle.

Defined cases: a null URL or one without ``://`` has an empty host and path, and no rule fits; an empty path
fits no rule, as every rule's path starts with ``/``. Duplicate rules: the last one of a list holds, the blocking one of a DataFrame. An empty list is
allowed. Rows are neither dropped nor merged; input columns other than those asked for aren't read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written_path

#: Rules that the driver passes on at a time.
CHUNK = 100_000
#: The rules of the query, as (text, verdict).
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

SLOT = np.dtype([("at", "<u8"), ("size", "<u4"), ("block", "u1")])
_mapped: dict[str, DigestArray] = {}


def digest(text: bytes) -> int:
    """As Spark's ``xxhash64`` has it."""
    d = xxhash.xxh64_intdigest(text, 42)
    return d - (d >> 63 << 64)


class DigestArray:
    """The three files, mapped read-only."""

    def __init__(self, stem: str):
        def load(kind: str, dtype) -> np.ndarray:
            path = SparkFiles.get(f"{stem}.{kind}")
            return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)

        self.keys, self.slots, self.texts = load("keys", "<i8"), load("slots", SLOT), load("texts", "u1")

    def probe(self, texts: list[bytes], keys: np.ndarray) -> np.ndarray:
        """The slot of each text, -1 for those that aren't in the list."""
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(texts), -1, np.int64)
        near = np.flatnonzero(at < len(self.keys))
        for i in near[self.keys[at[near]] == keys[near]]:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # several texts may share a digest
                s = self.slots[j]
                if self.texts[int(s["at"]) : int(s["at"]) + int(s["size"])].tobytes() == texts[i]:
                    found[i] = j
                    break
                j += 1
        return found


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(text, verdict), each text once: of a list the last, of a DataFrame (rule, verdict) the blocking one."""
    if isinstance(rules, DataFrame):
        return rules.toDF("text", "verdict").where("text is not null").groupBy("text").agg(F.max("verdict").alias("verdict"))
    return spark.createDataFrame(list({t: v for t, v in rules}.items()), "text string, verdict string")


def write_list(spark: SparkSession, table: DataFrame, key: str = "xxhash64(text)") -> str:
    """Write the list to the shared folder and hand it to the executors; returns the stem of its files' names. Spark sorts; the driver passes rows on and holds few of them."""
    folder = written_path(spark, "urls")
    stem = folder.rsplit("/", 1)[-1]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    outs = {kind: store.create(path(f"{folder}/{stem}.{kind}"), True) for kind in ("keys", "slots", "texts")}
    rows = table.select(F.expr(key).alias("key"), F.encode("text", "UTF-8").alias("text"), (F.col("verdict") == "block").alias("block")).orderBy("key", "text").toLocalIterator()
    at = 0
    while some := list(islice(rows, CHUNK)):
        slots = np.zeros(len(some), SLOT)
        sizes = np.array([len(r["text"]) for r in some])
        slots["at"], slots["size"], slots["block"] = at + np.cumsum(sizes) - sizes, sizes, [bool(r["block"]) for r in some]
        at += int(sizes.sum())
        outs["keys"].write(bytearray(np.array([r["key"] for r in some], "<i8").tobytes()))
        outs["slots"].write(bytearray(slots.tobytes()))
        outs["texts"].write(bytearray(b"".join(bytes(r["text"]) for r in some)))
    for kind, out in outs.items():
        out.close()
        spark.sparkContext.addFile(f"{folder}/{stem}.{kind}")
    return stem


def shapes(table: DataFrame) -> list[tuple[int, int]]:
    """(labels in the host, characters of the path) of the rules: as many as there are kinds of them, not rules."""
    host, path = F.substring_index("text", "/", 1), F.expr("substring(text, instr(text, '/'))")
    some = table.where("instr(text, '/') > 0").select((F.size(F.split(host, r"\.")).alias("n")), F.length(path).alias("size"))
    return sorted(((r["n"], r["size"]) for r in some.distinct().collect()), reverse=True)


def judge_urls(
    df: DataFrame,
    rules: list[tuple[str, str]] | DataFrame = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Per row: id, host, path, rule (null where none fits) and verdict; ``default`` where the list has no entry."""
    table = rule_table(df.sparkSession, rules)
    stem = write_list(df.sparkSession, table)
    kinds = shapes(table)
    url = F.col(url_col)
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    parts = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stem not in _mapped:
            _mapped[stem] = DigestArray(stem)
        table = _mapped[stem]
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts: list[bytes] = []
            owner: list[int] = []
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                if not p:
                    continue
                labels = h.split(".")
                for n, size in kinds:
                    if n <= len(labels) and size <= len(p):
                        texts.append((".".join(labels[-n:]) + p[:size]).encode())
                        owner.append(i)
            keys = np.fromiter(map(digest, texts), np.int64, len(texts))
            best: list[tuple[int, int] | None] = [None] * len(hosts)
            rule: list[str | None] = [None] * len(hosts)
            verdict = [default] * len(hosts)
            found = table.probe(texts, keys)
            for k in np.flatnonzero(found >= 0):
                i, text = owner[k], texts[k].decode()
                rank = (len(text), text.index("/"))
                if best[i] is None or rank > best[i]:
                    best[i], rule[i] = rank, text
                    verdict[i] = "block" if table.slots[found[k]]["block"] else "allow"
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return parts.mapInArrow(run, schema)
