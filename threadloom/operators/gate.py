"""Busy gate: while one answer is being produced, further triggers are dropped."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame

from threadloom.config import MAX_GROUP_ROWS
from threadloom.functions.times import micros, to_micros
from threadloom.operators.thinning import greedy_thin


def trigger_gate(triggers: DataFrame, busy: timedelta,
                 max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Triggers that are answered: per channel the first, then each first one sent ``busy`` or
    more after the last answered one."""
    points = triggers.select("channelid", "messageid", micros(triggers, "sent").alias("t"))
    kept = greedy_thin(points, ["channelid"], to_micros(busy) - 1, max_group_rows=max_group_rows)
    return triggers.join(kept, "messageid", "left_semi").select("channelid", "messageid", "sent")
