"""References that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.operators.replies import with_target


def unresolved_refs(messages: DataFrame, names: DataFrame, cfg: ChatConfig) -> DataFrame:
    """(kind, messages): messages whose author or channel has no name, whose reply has no
    usable target, or whose time could not be read. Counted per id before the join, so a busy author or channel is one row."""

    def unnamed(column: str, kind: str, rows: DataFrame) -> DataFrame:
        per_id = rows.groupBy(F.col(column).cast("string").alias("id")).agg(F.count("*").alias("n"))
        return (per_id.join(names, "id", "left_anti")
                .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages")).select(F.lit(kind).alias("kind"), "messages"))

    authors = messages.filter(F.col("userid") != cfg.bot_id)
    replies = messages.withColumn("assigned", F.lit(False))
    lost = (with_target(replies, time="sent").filter(F.col("replyid").isNotNull() & F.col("target").isNull())
            .agg(F.count("*").alias("messages")).select(F.lit("reply_target").alias("kind"), "messages"))
    untimed = (messages.filter(F.col("sent").isNull())
               .agg(F.count("*").alias("messages")).select(F.lit("sent").alias("kind"), "messages"))
    return (unnamed("userid", "author", authors)
            .unionByName(unnamed("channelid", "channel", messages))
            .unionByName(lost).unionByName(untimed))
