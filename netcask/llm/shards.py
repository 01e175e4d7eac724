"""Sharding by Karmarkar-Karp differencing: groups of equal texts go whole to one of ``n`` shards, bytes near equal.

1. One pass over the texts keeps a slim table (id, size, CRC, SHA-256); groups and their bytes come from it by a
   ``groupBy`` that combines before its shuffle, so a group that holds a third of all rows is one row here.
2. Groups are dealt by digest to tasks of about ``BLOCK`` groups. Each task starts with a partial partition (x, 0, ..., 0) for every group,
   in blocks of at most ``BLOCK`` groups, and repeatedly combines the two of largest spread, the largest part of one with the
   smallest of the other. What is left is one tuple of ``n`` sums for a task.
3. Tuples are combined in the same way, ``FAN`` to one, in a tree of as many levels as there are powers of ``FAN`` in the
   number of tasks. Going down the tree again gives the shard of every part of every tuple. The driver holds none of it.
4. Slots: every row gets a bucket by its place in the job, written with it, so that even equal rows spread. Rows are
   counted by (bucket, shard), offsets are running sums of those few counts, and row numbers are taken within a
   bucket and shard. No task ever sees a whole shard.

Defined cases: a null text counts as an empty one (size 8, CRC 0) and is of the same group; repeated rows are rows; an empty table
gives an empty result; other columns are ignored. A group as large as the mean of the shards that are left has a shard of its own (there are
fewer than ``n`` of these), and the others share the rest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

BLOCK, FAN = 65_536, 256


class Forest:
    """Members of parts as a binary forest: a part is a node, combined parts are a node over both."""

    def __init__(self, leaves: int):
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves = leaves

    def join(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        self.left.append(a)
        self.right.append(b)
        return self.leaves + len(self.left) - 1

    def resolve(self, roots: list[int]) -> np.ndarray:
        """For each leaf, the index of the root above it."""
        of = np.full(self.leaves + len(self.left), -1, np.int64)
        for k, r in enumerate(roots):
            if r >= 0:
                of[r] = k
        for i in range(len(self.left) - 1, -1, -1):  # parents come after their children
            k = of[self.leaves + i]
            of[self.left[i]] = of[self.right[i]] = k
        return of[: self.leaves]


def difference(tuples: list[tuple[np.ndarray, list[int]]], forest: Forest) -> tuple[np.ndarray, list[int]]:
    """Combine until one partial partition is left. Each has its sums in descending order, and a node for each."""
    heap = [(-int(s[0] - s[-1]), k) for k, (s, _) in enumerate(tuples)]
    heapq.heapify(heap)
    held = dict(enumerate(tuples))
    fresh = len(tuples)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, na), (sb, nb) = held.pop(a), held.pop(b)
        total = sa + sb[::-1]
        order = np.argsort(-total, kind="stable")
        nodes = [forest.join(x, y) for x, y in zip(na, reversed(nb), strict=True)]
        held[fresh] = (s := total[order], [nodes[i] for i in order])
        heapq.heappush(heap, (-int(s[0] - s[-1]), fresh))
        fresh += 1
    return next(iter(held.values()))


def differ_sizes(sizes: np.ndarray, n: int) -> np.ndarray:
    """The part (0 to n-1) of each size."""
    forest = Forest(len(sizes))
    blocks = []
    for at in range(0, len(sizes), BLOCK):
        singles = []
        for i in range(at, min(at + BLOCK, len(sizes))):
            s = np.zeros(n, np.int64)
            s[0] = sizes[i]
            singles.append((s, [i] + [-1] * (n - 1)))
        blocks.append(difference(singles, forest))
    return forest.resolve(difference(blocks, forest)[1]) if blocks else np.empty(0, np.int64)


def merge_sums(sums: np.ndarray) -> np.ndarray:
    """By differencing tuples of sums, a row each: where each of their parts goes."""
    forest = Forest(sums.size)
    start = []
    for i, s in enumerate(sums):
        order = np.argsort(-s, kind="stable")
        start.append((s[order], (i * sums.shape[1] + order).tolist()))
    return forest.resolve(difference(start, forest)[1]).reshape(sums.shape)


def merge_tree(parts: DataFrame, n: int, tasks: int, fan: int = FAN) -> DataFrame:
    """(task, part, shard) from (task, part, bytes): tuples of ``fan`` tasks become one, and so on until one is left."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        task, part, size = (table.column(c).to_numpy() for c in ("task", "part", "bytes"))
        names, row = np.unique(task, return_inverse=True)
        sums = np.zeros((len(names), n), np.int64)
        sums[row, part] = size
        to = merge_sums(sums)[row, part]
        return pa.table({"task": table.column("task"), "part": table.column("part"), "up": pa.array(np.full(len(task), key[0].as_py(), np.int64)), "shard": pa.array(to.astype(np.int32)), "bytes": table.column("bytes")})

    schema = "task long, part int, up long, shard int, bytes long"
    levels = []
    while True:
        level = materialize(parts.withColumn("up", F.expr(f"task div {fan}")).groupBy("up").applyInArrow(merge, schema), "shard-level")
        levels.append(level)
        tasks = -(-tasks // fan)
        if tasks <= 1:
            break
        parts = level.groupBy(F.col("up").alias("task"), F.col("shard").alias("part")).agg(F.sum("bytes").alias("bytes"))
    plan = levels.pop().select("task", "part", "shard")
    while levels:
        above = plan.select(F.col("task").alias("up"), F.col("part").alias("mid"), F.col("shard").alias("top"))
        plan = levels.pop().withColumnRenamed("shard", "mid").join(above, ["up", "mid"]).select("task", "part", F.col("top").alias("shard"))
    return plan


def shard_documents(docs: DataFrame, n: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (UTF-8 bytes + 8), text_crc32, law ``bytes``, shard, slot (gapless from 0), grown_shard (null)."""
    spark = docs.sparkSession
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    slim = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(data) + 8).cast("long").alias("size"),
            F.crc32(data).alias("crc"),
            F.unhex(F.sha2(data, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = materialize(slim.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-sizes")
    count, left = groups.agg(F.count("*"), F.sum("bytes")).first()
    alone: list[bytes] = []
    for r in groups.orderBy(F.desc("bytes"), "digest").limit(n - 1).collect():  # n - 1 rows
        if r["bytes"] * (n - len(alone)) < left:
            break
        alone.append(bytes(r["digest"]))
        left -= r["bytes"]
    rest = n - len(alone)
    tasks = max(shuffle_partitions(spark), -(-count // BLOCK))
    groups = groups.where(~F.col("digest").isin(alone)).withColumn("task", F.pmod(F.xxhash64("digest"), F.lit(tasks)))

    def deal(table: pa.Table) -> pa.Table:
        sizes, digests = table.column("bytes").to_numpy(), table.column("digest").to_pylist()
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], digests[i]))  # a rerun deals alike
        part = np.empty(len(sizes), np.int32)
        part[order] = differ_sizes(sizes[order], rest)
        return pa.table({"digest": table.column("digest"), "bytes": table.column("bytes"), "task": table.column("task"), "part": part})

    dealt = materialize(groups.groupBy("task").applyInArrow(deal, "digest binary, bytes long, task long, part int"), "shard-groups")
    plan = merge_tree(dealt.groupBy("task", "part").agg(F.sum("bytes").alias("bytes")), rest, tasks)
    where = dealt.join(plan, ["task", "part"]).select("digest", "shard")
    if alone:
        where = where.unionByName(spark.createDataFrame([(bytearray(d), rest + k) for k, d in enumerate(alone)], "digest binary, shard int"))
    placed = materialize(
        slim.join(where, "digest").select("id", "size", "crc", "shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)).alias("bucket")),
        "shard-placed",
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "size", "crc")
    return (
        placed.withColumn("row", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("shard"),
            (F.col("before") + F.col("row")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
