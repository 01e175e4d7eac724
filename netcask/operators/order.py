"""Order-dependent steps without a global window.

A window over a whole table runs in one task. These helpers cut the order into buckets of ``WIDTH`` index values, aggregate each bucket, run the
carry over the few bucket rows, and finish inside the buckets: two narrow shuffles, and no task sees more than a
bucket. ``order`` is a non-negative long whose values are about dense, such as ``pkt_idx``; ties are broken by ``ties``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import whole_div

WIDTH = 1 << 16


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", whole_div(F.col(order), width))


def _carry() -> Window:
    return Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over bucket rows only


def with_prefix_sum(df: DataFrame, value: Column, name: str, order: str = "pkt_idx", ties: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows."""
    b = _bucketed(df, order, width).withColumn("_value", value)
    before = b.groupBy("_bucket").agg(F.sum("_value").alias("_sum")).select("_bucket", F.coalesce(F.sum("_sum").over(_carry()), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = b.join(before, "_bucket")
    return joined.withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_bucket", "_value", "_before")


def with_position(df: DataFrame, name: str = "pos", order: str = "pkt_idx", ties: tuple[str, ...] = (), width: int = WIDTH, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: the row's number in order, from 0, without gaps; in each group of ``by``, if given."""
    b = _bucketed(df, order, width)
    n = b.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    carry = (Window.partitionBy(*by).orderBy("_bucket") if by else Window.orderBy("_bucket")).rowsBetween(Window.unboundedPreceding, -1)  # over bucket rows only
    before = n.select(*by, "_bucket", F.coalesce(F.sum("_n").over(carry), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order, *ties)
    return b.join(before, [*by, "_bucket"]).withColumn(name, (F.col("_before") + F.row_number().over(inside) - 1).cast("long")).drop("_bucket", "_before")


def with_running_max(df: DataFrame, value: Column, name: str, order: str = "pkt_idx", ties: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """Add ``name``: the greatest ``value`` up to and with the row."""
    b = _bucketed(df, order, width).withColumn("_value", value)
    before = b.groupBy("_bucket").agg(F.max("_value").alias("_most")).select("_bucket", F.max("_most").over(_carry()).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return b.join(before, "_bucket").withColumn(name, F.greatest(F.max("_value").over(inside), F.col("_before"))).drop("_bucket", "_value", "_before")


def with_previous(df: DataFrame, value: Column, name: str, order: str = "pkt_idx", ties: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """Add ``name``: ``value`` of the row before; NULL for the first."""
    b = _bucketed(df, order, width).withColumn("_value", value)
    ends = b.groupBy("_bucket").agg(F.max_by("_value", F.struct(order, *ties)).alias("_end"))
    before = ends.select("_bucket", F.lag("_end").over(Window.orderBy("_bucket")).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(order, *ties)
    at = F.row_number().over(inside)
    return b.join(before, "_bucket").withColumn(name, F.when(at == 1, F.col("_before")).otherwise(F.lag("_value").over(inside))).drop("_bucket", "_value", "_before")


def with_last_known(df: DataFrame, value: Column, name: str, by: str, order: str = "pkt_idx", width: int = WIDTH) -> DataFrame:
    """Add ``name``: the last ``value`` that isn't NULL of the earlier rows with the same ``by``."""
    b = _bucketed(df, order, width).withColumn("_value", value)
    ends = b.where(F.col("_value").isNotNull()).groupBy(by, "_bucket").agg(F.max_by("_value", order).alias("_end"))
    every = b.select(by, "_bucket").distinct().join(ends, [by, "_bucket"], "left")
    carry = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over bucket rows only
    before = every.select(by, "_bucket", F.last("_end", ignorenulls=True).over(carry).alias("_before"))
    inside = Window.partitionBy(by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_before"))
    return b.join(before, [by, "_bucket"]).withColumn(name, found).drop("_bucket", "_value", "_before")


def first_value(df: DataFrame, value: str, order: str = "pkt_idx") -> DataFrame:
    """One row with ``value`` of the first row, as column ``first``; to be joined by a broadcast of that one row."""
    return df.agg(F.min_by(value, order).alias("first"))


def _stretches(df: DataFrame, order: str, width: int) -> DataFrame:
    """Add ``_bucket``; rows without a place are the last."""
    return df.withColumn("_bucket", whole_div(F.coalesce(F.col(order), F.lit((1 << 63) - 1)), width))


def states(
    df: DataFrame, by: list[str], columns: list[str], start: Any, run: Callable, order: str = "pkt_idx", width: int = WIDTH, kinds: str = "_state binary", tell: Callable = lambda before, after: (pickle.dumps(before),)
) -> DataFrame:
    """(``by``, ``_bucket``, ``kinds``): what ``tell`` has of the state of a fold before and after each bucket; the state before, if not given. The fold is sequential in each group of
    ``by``: a task runs over ``columns`` only, and holds a batch. Ties of ``order`` are broken by them."""
    d = _stretches(df, order, width).select(*by, "_bucket", order, *(c for c in columns if c not in (*by, order)))
    d = d.repartition(*by).sortWithinPartitions(*by, *(F.asc_nulls_last(c) for c in (order, *columns)))
    lead = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    told = list(to_arrow_schema(T.StructType.fromDDL(kinds)))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = state = before = None
        done: list[tuple] = []

        def rows_of(b: pa.RecordBatch) -> pa.RecordBatch:
            fields = [*(b.schema.field(i) for i in range(len(by) + 1)), *told]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), fields, strict=True)], names=[f.name for f in fields])

        for b in batches:
            first = 0
            for key, rows in groupby(zip(*(b.column(i).to_pylist() for i in range(len(by) + 1)), strict=True)):
                n = sum(1 for _ in rows)
                if at != key:
                    if at is not None:
                        done.append((*at, *tell(before, state)))
                    if at is None or at[:-1] != key[:-1]:
                        state = start
                    at, before = key, state
                state, _ = run(state, pa.Table.from_batches([b.slice(first, n)]))
                first += n
            if len(done) > 1000:
                yield rows_of(b)
                done = []
        if at is not None:
            done.append((*at, *tell(before, state)))
            yield rows_of(b)

    return d.mapInArrow(carry, f"{lead}, _bucket long, {kinds}")


def fold(df: DataFrame, by: list[str], columns: list[str], start: Any, run: Callable, schema: T.StructType, order: str = "pkt_idx", width: int = WIDTH) -> DataFrame:
    """A fold in order within each group of ``by``: ``run(state, rows)`` takes a stretch of rows in order and gives (state, rows as ``schema`` has them). It must not change
    the state that it is given, and reads ``columns``. It runs twice: once over these columns to know the state before each bucket, then over whole rows, buckets apart."""
    before = states(df, by, columns, start, run, order, width)

    def finish(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        return run(pickle.loads(state.column("_state")[0].as_py()), rows.drop_columns("_bucket").sort_by([(c, "ascending") for c in (order, *columns)]))[1].select(schema.names)

    parts = _stretches(df, order, width).groupBy(*by, "_bucket")
    return parts.cogroup(before.groupBy(*by, "_bucket")).applyInArrow(finish, schema)


def added(rows: pa.Table, name: str, values: pa.Array) -> pa.Table:
    """The rows with a column that is new or takes the place of the one of that name."""
    return rows.set_column(rows.schema.get_field_index(name), name, values) if name in rows.schema.names else rows.append_column(name, values)
