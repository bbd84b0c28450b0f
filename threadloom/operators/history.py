"""The last few rows before (or up to) each target row of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.config import MAX_GROUP_ROWS
from threadloom.operators.ordered import group_sizes, ordered
from threadloom.operators.skew import hot_join
from threadloom.storage import materialize


def with_history(rows: DataFrame, keys: list[str], order: list[str], *, is_target: Column,
                 lookback: int, include_self: bool, item: str, late: DataFrame | None = None,
                 prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, out: str = "history",
                 unique: str = "messageid", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Target rows with array ``out``: ``item`` of the ``lookback`` rows before, oldest first.

    Null items take a place in the window but not in the array. With ``include_self`` the
    target's own item comes last. ``prepare`` derives what is needed, such as the item, one row
    at a time.

    Groups without a target leave before the shuffle that brings groups together, rows no target
    looks back at leave right after it, and only then ``prepare`` runs. When a group is too large
    for one task, rows get their exact position, groups are cut into blocks of positions, and the
    last ``lookback`` rows of a block are copied to the next one.

    Wide columns belong in ``late`` (``unique`` and what ``prepare`` or the result reads besides):
    the rows needed are found without them, written, and joined with ``late`` by ``unique``. Where
    their written size is below Spark's limit they are sent to the tasks that read ``late``, and only
    their own wide values move, once, to their groups.
    """
    largest, _ = group_sizes(rows, keys)
    rows = rows.withColumn("_target", is_target)
    wanted = rows.filter("_target").select(*keys).distinct()
    rows = (hot_join(rows, wanted, keys[0], max_group_rows, "left_semi", hot=largest > max_group_rows)
            if len(keys) == 1 else rows.join(wanted, keys, "left_semi"))
    if largest <= max_group_rows:
        group = [*keys]
        rows = rows.withColumn(
            "_pos", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    else:
        size = max(max_group_rows, lookback)
        narrow = rows.select(*dict.fromkeys([*keys, *order, unique]))
        positions = ordered(narrow, keys, order, max_group_rows).with_position("_pos")
        block = F.floor(F.col("_pos") / size)
        near_end = F.pmod("_pos", F.lit(size)) >= size - lookback
        group = [*keys, "_block"]
        rows = (rows.join(positions.plain().select(unique, "_pos"), unique)
                .withColumn("_home", block)
                .withColumn("_block", F.explode(
                    F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
                .withColumn("_target", F.col("_target") & (F.col("_block") == F.col("_home"))))
    by_position = Window.partitionBy(*group).orderBy("_pos")
    ahead = by_position.rowsBetween(Window.currentRow, lookback)
    behind = by_position.rangeBetween(-lookback, 0 if include_self else -1)
    needed = rows.withColumn("_needed", F.max("_target").over(ahead)).filter("_needed")
    if late is not None:
        needed = late.join(materialize(needed, "needed"), unique)
    return (prepare(needed)
            .withColumn(out, F.collect_list(item).over(behind))
            .filter("_target")
            .drop("_target", "_needed", "_pos", "_home", "_block"))
