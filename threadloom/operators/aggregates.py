"""Per-channel and whole-table figures. All are hash aggregates with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.config import UNASSIGNED, ChatConfig
from threadloom.operators.ordered import first_per_group
from threadloom.operators.scrub import clean_flags


def latest_per_channel(messages: DataFrame) -> DataFrame:
    """Newest message of each channel."""
    return messages.groupBy("channelid").agg(
        F.max_by("messageid", F.struct("sent", "messageid")).alias("messageid"))


def latest_n_per_channel(messages: DataFrame, n: int, item: Column) -> DataFrame:
    """(channelid, items): ``item`` of the newest ``n`` messages, oldest first."""
    newest = first_per_group(
        messages.select("channelid", "sent", "messageid", item.alias("_item")), ["channelid"],
        [F.col("sent").desc(), F.col("messageid").desc()], n, F.col("messageid"))
    in_order = F.array_sort(F.collect_list(F.struct("sent", "messageid", "_item")))
    return (newest.groupBy("channelid").agg(in_order.alias("_rows"))
            .select("channelid", F.col("_rows._item").alias("items")))


def distinct_conversations(messages: DataFrame) -> DataFrame:
    return messages.select("conversid").distinct()


def ingest_stats(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("channelid").agg(F.count("*").alias("fetched"))


def clean_stats(messages: DataFrame, cfg: ChatConfig) -> DataFrame:
    """One row: messages whose text changed, and messages left without text."""
    return clean_flags(messages, cfg).agg(
        F.count_if("is_changed").alias("cleaned"), F.count_if("is_empty").alias("empty"))


def conversation_stats(assigned: DataFrame) -> DataFrame:
    """Per channel: messages newly sorted, conversations newly opened."""
    return assigned.groupBy("channelid").agg(
        F.count("*").alias("sorted"), F.count_if("isFirstInConvers").alias("conversations"))


def example_stats(examples: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: examples made, and conversations they were made from (assigned messages only)."""
    made = examples.agg(F.count("*").alias("examples"), F.lit(0).cast("long").alias("conversations"))
    read = (messages.filter(F.col("conversid") != UNASSIGNED)
            .agg(F.lit(0).cast("long").alias("examples"), F.count_distinct("conversid").alias("conversations")))
    return made.unionByName(read).agg(
        F.max("examples").alias("examples"), F.max("conversations").alias("conversations"))
