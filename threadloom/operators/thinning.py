"""Greedy thinning: keep a group's first point, then each first point beyond the last kept
one by more than a gap. Both conversation breaks and the busy gate are this rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import MAX_GROUP_ROWS
from threadloom.operators.ordered import group_sizes, ordered
from threadloom.operators.skew import hot_join
from threadloom.storage import materialize


def greedy_thin(points: DataFrame, keys: list[str], gap: int, *, time: str = "t",
                unique: str = "messageid", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``unique`` of the kept points. ``time`` is a bigint; a point is kept when it lies more
    than ``gap`` after the last kept one.

    The result is stored, so that Spark knows its size (mostly small) when it is joined.
    """
    points = points.select(*keys, F.col(time).alias("_t"), F.col(unique).alias("_id"))
    largest, _ = group_sizes(points, keys)
    if largest <= max_group_rows:
        kept = _fold(points, keys, gap)
        return materialize(kept.select(F.col("_id").alias(unique)), "kept")
    # At most (all rows / max_group_rows) groups are large.
    large = (points.groupBy(*keys).agg(F.count("*").alias("_n"))
             .filter(F.col("_n") > max_group_rows).select(*keys))
    small_kept = _fold(points.join(F.broadcast(large), keys, "left_anti"), keys, gap)
    large_kept = _leap(points.join(F.broadcast(large), keys, "left_semi"), keys, gap, max_group_rows)
    kept = small_kept.select("_id").unionByName(large_kept)
    return materialize(kept.select(F.col("_id").alias(unique)), "kept")


def _fold(points: DataFrame, keys: list[str], gap: int, block: int = 256, inner: int = 16) -> DataFrame:
    """One walk over each group's sorted points, in blocks of blocks.

    Spark copies the state of ``aggregate`` at every element, so no list may grow with the group. The
    walk carries the last kept time alone, and notes it once a block. From this a block is walked
    again by itself, in the same way over its inner blocks, and an inner block lists its kept points.
    """
    def beyond(last, point):
        return last.isNull() | (point["_t"] - last > gap)

    def after(part, start):
        return F.aggregate(part, start, lambda last, point: F.when(beyond(last, point), point["_t"]).otherwise(last))

    def in_blocks(part, size):
        return F.transform(F.sequence(F.lit(1), F.size(part), F.lit(size)), lambda at: F.slice(part, at, size))

    def starts(parts, start):
        """The last kept time before each of the parts."""
        begin = F.struct(start.alias("last"), F.array().cast("array<bigint>").alias("starts"))
        return F.aggregate(parts, begin, lambda state, part: F.struct(
            after(part, state["last"]).alias("last"), F.array_append(state["starts"], state["last"]).alias("starts")), lambda end: end["starts"])

    def kept(part, start):
        begin = F.struct(start.alias("last"), F.array().cast("array<bigint>").alias("kept"))
        return F.aggregate(part, begin, lambda state, point: F.when(beyond(state["last"], point), F.struct(
            point["_t"].alias("last"), F.array_append(state["kept"], point["_id"]).alias("kept"))).otherwise(state), lambda end: end["kept"])

    rows = (points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_t", "_id"))).alias("_points"))
            .select(*keys, in_blocks(F.col("_points"), block).alias("_blocks")))
    rows = rows.select(*keys, F.explode(F.arrays_zip("_blocks", starts(F.col("_blocks"), F.lit(None).cast("long")).alias("_starts"))).alias("_b"))
    rows = rows.select(*keys, in_blocks(F.col("_b._blocks"), inner).alias("_parts"), F.col("_b._starts").alias("_start"))
    return rows.select(*keys, F.explode(F.flatten(F.zip_with("_parts", starts(F.col("_parts"), F.col("_start")), kept))).alias("_id"))


def _leap(points: DataFrame, keys: list[str], gap: int, max_group_rows: int) -> DataFrame:
    """The same for groups too large for one task.

    Every point gets a pointer to the point that would be kept next after it. The kept points
    are those reached from the group's first point. Doubling the pointers each round reaches
    them in about log2(kept points) rounds of equi-joins.
    """
    # Scanned from the latest time back, the last point seen before a probe at (time + gap)
    # is the first point beyond it. Probes precede points of equal time: "beyond" is strict.
    ends = (points.select(*keys, (-F.col("_t")).alias("_s"), F.lit(1).alias("_kind"),
                          (-F.col("_id")).alias("_r"), "_id")
            .unionByName(points.select(*keys, (-F.col("_t") - gap).alias("_s"), F.lit(0).alias("_kind"),
                                       (-F.col("_id")).alias("_r"), "_id")))
    scan = ordered(ends, keys, ["_s", "_kind", "_r"], max_group_rows)
    seen = scan.with_running_last("_next", F.when(F.col("_kind") == 1, F.col("_id"))).plain()
    leaps = materialize(
        seen.filter((F.col("_kind") == 0) & F.col("_next").isNotNull()).select("_id", "_next"), "leaps")

    reached = materialize(
        points.groupBy(*keys).agg(F.min(F.struct("_t", "_id")).alias("_first"))
        .select(F.col("_first._id").alias("_id")), "reached")
    while True:
        # ``reached`` holds the first 2^k kept points and ``leaps`` jumps 2^k points ahead.
        hop = materialize(
            reached.join(leaps, "_id").select(F.col("_next").alias("_id")), "hop")
        if hop.isEmpty():
            return reached
        reached = reached.unionByName(hop)
        onward = leaps.select(F.col("_id").alias("_next"), F.col("_next").alias("_after"))
        leaps = materialize(
            hot_join(leaps, onward, "_next", max_group_rows).select("_id", F.col("_after").alias("_next")), "leaps")
