"""Timestamp helpers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


WITH_OFFSET = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})$"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        epoch = F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(name))
    return F.unix_micros(F.col(name))


def to_micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def parse_sent(text: Column) -> Column:
    """Timestamp from text with an offset, with or without a fraction; other text gives null."""
    return F.when(text.rlike(WITH_OFFSET), text.try_cast("timestamp"))


def format_sent(sent: Column) -> Column:
    """Text of a timestamp in UTC; the fraction (six digits) shows only when it is not zero.

    A timestamp without a time zone is taken for UTC; one with a zone is shown in UTC whatever the
    session's zone is.
    """
    zoned = F.convert_timezone(None, F.lit("UTC"), sent.cast("timestamp"))
    text = F.when(F.typeof(sent) == "timestamp_ntz", sent.cast("timestamp_ntz")).otherwise(zoned).cast("string")
    fraction = F.regexp_extract(text, r"\.(\d+)$", 1)
    shown = F.when(fraction != "", F.concat(F.lit("."), F.rpad(fraction, 6, "0"))).otherwise(F.lit(""))
    return F.concat(F.substring_index(text, ".", 1), shown, F.lit("+00:00"))
