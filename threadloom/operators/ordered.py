"""Ordered computations per group that do not put a large group into one task.

A window over ``partitionBy(channel)`` sends a whole channel to one task, which fails when one
channel holds much of the data. ``ordered`` checks the largest group first. Up to the limit it
stays a plain window. Beyond it, rows are range-partitioned on (group, order), so a large group
becomes several consecutive chunks; windows run per (group, chunk) and one small row per chunk
carries what the earlier chunks of the group leave behind. Of the groups in a chunk only the
first can have begun in an earlier chunk, so the carried table has at most one row per chunk and
is safe to broadcast whatever the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.config import MAX_GROUP_ROWS
from threadloom.storage import materialize

CHUNK = "_chunk"
MAX_CHUNKS = 20_000  # keeps the shuffle and the carried table small; chunks just grow beyond it
# A task and a file a chunk: a limit far below what a task can take makes no more than these, whatever
# the input's size; beyond them a chunk has up to MAX_GROUP_ROWS rows.
FEW_CHUNKS = 200


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows in the largest group, rows in all)."""
    row = (df.groupBy(*keys).agg(F.count("*").alias("n"))
           .agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first())
    return row["largest"] or 0, row["total"] or 0


@dataclass(frozen=True)
class Ordered:
    """Rows with a group, a unique order inside it and, for large groups, a chunk."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    @property
    def group(self) -> list[str]:
        return [*self.keys, CHUNK] if self.split else [*self.keys]

    @property
    def window(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def with_rows(self, rows: DataFrame) -> "Ordered":
        return replace(self, rows=rows)

    def materialized(self, label: str) -> "Ordered":
        return self.with_rows(materialize(self.rows, label))

    def plain(self) -> DataFrame:
        return self.rows.drop(CHUNK)

    def _last_of_chunk(self, value: Column) -> DataFrame:
        """Last non-null value of each (group, chunk)."""
        at = F.when(value.isNotNull(), F.struct(*self.order))
        return self.rows.groupBy(*self.group).agg(F.max_by(value, at).alias("_tail"))

    def _attach(self, carried: DataFrame) -> DataFrame:
        return self.rows.join(F.broadcast(carried), self.group, "left")

    def with_previous(self, out: str, *columns: str) -> "Ordered":
        """Adds struct ``out``: the named columns of the row before, null for a group's first."""
        value = F.struct(*columns)
        if not self.split:
            return self.with_rows(self.rows.withColumn(out, F.lag(value).over(self.window)))
        chunks = Window.partitionBy(*self.keys).orderBy(CHUNK)
        carried = (self._last_of_chunk(value)
                   .select(*self.group, F.lag("_tail").over(chunks).alias("_carried"))
                   .filter(F.col("_carried").isNotNull()))
        rows = self._attach(carried).withColumn(
            out, F.coalesce(F.lag(value).over(self.window), F.col("_carried")))
        return self.with_rows(rows.drop("_carried"))

    def with_running_last(self, out: str, value: Column) -> "Ordered":
        """Adds ``out``: the last non-null ``value`` up to and with the row."""
        base = self.with_rows(self.rows.withColumn("_value", value))
        upto = base.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = F.last("_value", ignorenulls=True).over(upto)
        if not self.split:
            return self.with_rows(base.rows.withColumn(out, here).drop("_value"))
        before = (Window.partitionBy(*self.keys).orderBy(CHUNK)
                  .rowsBetween(Window.unboundedPreceding, -1))
        carried = (base._last_of_chunk(F.col("_value"))
                   .select(*self.group, F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
                   .filter(F.col("_carried").isNotNull()))
        rows = base._attach(carried).withColumn(out, F.coalesce(here, F.col("_carried")))
        return self.with_rows(rows.drop("_value", "_carried"))

    def with_running_count(self, out: str, condition: Column) -> "Ordered":
        """Adds ``out``: how many rows up to and with this one satisfy ``condition``."""
        base = self.with_rows(self.rows.withColumn("_one", condition.cast("long")))
        upto = base.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = F.coalesce(F.sum("_one").over(upto), F.lit(0))
        if not self.split:
            return self.with_rows(base.rows.withColumn(out, here).drop("_one"))
        before = (Window.partitionBy(*self.keys).orderBy(CHUNK)
                  .rowsBetween(Window.unboundedPreceding, -1))
        carried = (base.rows.groupBy(*self.group).agg(F.sum("_one").alias("_n"))
                   .select(*self.group, F.sum("_n").over(before).alias("_carried"))
                   .filter(F.col("_carried").isNotNull()))
        rows = base._attach(carried).withColumn(out, here + F.coalesce("_carried", F.lit(0)))
        return self.with_rows(rows.drop("_one", "_carried"))

    def with_position(self, out: str) -> "Ordered":
        """Adds ``out``: 0-based position in the group."""
        if not self.split:
            position = F.row_number().over(self.window).cast("long") - 1
            return self.with_rows(self.rows.withColumn(out, position))
        counted = self.with_running_count(out, F.lit(True))
        return self.with_rows(counted.rows.withColumn(out, F.col(out) - 1))


def chunk_count(total: int, max_group_rows: int) -> int:
    rows = max(max_group_rows, min(MAX_GROUP_ROWS, math.ceil(total / FEW_CHUNKS)))
    return min(MAX_CHUNKS, 1 + math.ceil(total / rows))


def ordered(df: DataFrame, keys: list[str], order: list[str],
            max_group_rows: int = MAX_GROUP_ROWS, sizes: tuple[int, int] | None = None) -> Ordered:
    """``df`` prepared for ordered computations; ``keys + order`` must be unique, keys not null.

    ``sizes`` may hand in the group sizes where they are known from a cheaper table.
    """
    largest, total = sizes or group_sizes(df, keys)
    if largest <= max_group_rows:
        return Ordered(df, tuple(keys), tuple(order), split=False)
    chunks = chunk_count(total, max_group_rows)
    ranged = df.repartitionByRange(chunks, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return Ordered(materialize(ranged, "chunks"), tuple(keys), tuple(order), split=True)


def with_row_index(df: DataFrame, order: list[str], out: str = "row_index") -> DataFrame:
    """Adds the 0-based position of each row in the whole of ``df``, ordered by unique ``order``.

    Sorted range partitions number their own rows; the row counts of the partitions before
    (one small row each) turn that into a position in the whole.
    """
    numbered = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()), "row-index")
    # The id holds the partition in its upper 31 bits and the row inside it in the lower 33.
    numbered = numbered.withColumn(CHUNK, F.shiftright("_id", 33))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy(CHUNK).agg(F.count("*").alias("_n"))
               .select(CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (numbered.join(F.broadcast(offsets), CHUNK)
            .withColumn(out, F.col("_offset") + local)
            .drop("_id", CHUNK, "_offset"))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                    spread: Column, out: str = "rank", salts: int = 32) -> DataFrame:
    """The first ``n`` rows of each group, ranked from 1.

    Taken in two steps, first per (group, salt): Spark cuts each map task's output to ``n`` per
    group before the shuffle, and the salts keep what is left of a large group off a single task.
    """
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
            .withColumn("_rank", F.row_number().over(salted)).filter(F.col("_rank") <= n)
            .drop("_salt", "_rank")
            .withColumn(out, F.row_number().over(whole)).filter(F.col(out) <= n))
