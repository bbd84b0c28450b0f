"""Joins whose left side may hold much of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.storage import materialize


def hot_join(left: DataFrame, right: DataFrame, key: str, max_key_rows: int, how: str = "inner",
             hot: bool = True) -> DataFrame:
    """``left`` joined with ``right`` (unique in ``key``), ``how`` being inner, left or left_semi.

    Keys with more than ``max_key_rows`` left rows, of which there are at most (left rows /
    max_key_rows), are joined by broadcast of just their right rows; all others by a plain join. They
    are counted first, on the key alone, so where there is none the plan has the plain join and
    nothing else. With ``hot=False`` the caller knows that no such key exists.
    """
    if left.isStreaming or not hot:
        return left.join(right, key, how)
    keys = (left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_key_rows)
            .filter(F.col(key).isNotNull()).select(key))
    keys = materialize(keys, "hot-keys")
    if keys.isEmpty():
        return left.join(right, key, how)
    few = right.join(F.broadcast(keys), key, "left_semi")
    large = left.join(F.broadcast(keys), key, "left_semi").join(F.broadcast(few), key, how)
    rest = left.join(F.broadcast(keys), key, "left_anti").join(right, key, how)
    return rest.unionByName(large)


def has_hot_key(rows: DataFrame, key: str, max_key_rows: int) -> bool:
    """Whether some value of ``key`` has more rows than that, counted on the key itself."""
    return not (rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
                .filter(F.col("_n") > max_key_rows).isEmpty())
