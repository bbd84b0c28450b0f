"""Chat messages derived from the given tables, as described in FIXTURES.md."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.operators.ordered import ordered

CFG = ChatConfig(bot_id=4, user_id=2, names={"1": "Ann", "2": "Tom", "3": "Jo$e"})
SPLIT = datetime(2024, 1, 15)

# Settings for the `conversations` table: roles take the place of members.
ROLES = {"system": 1, "assistant": 2, "user": 3}
ROLE_CFG = ChatConfig(bot_id=4, user_id=2, names={"1": "system", "2": "assistant", "3": "user"})

CONTENT = """
    CASE event_id % 10
      WHEN 0 THEN ''
      WHEN 1 THEN concat('/kc ', event_type, ' ', event_id)
      WHEN 2 THEN concat(event_type, ' https://ex.am/p?q=', event_id, ' end')
      WHEN 3 THEN concat('<@', 1 + (event_id % 11) % 4, '> hi <:smile:', event_id, '>')
      WHEN 4 THEN concat('<@1>  x <@2>', event_type, ' <@1> tail')
      WHEN 5 THEN concat('  <#77> ', event_type, ' <@!3>  ')
      WHEN 6 THEN concat('https://only.link/', event_id)
      WHEN 8 THEN concat('<@1> <@21> ', event_type)
      ELSE concat(event_type, ' ', event_id) END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_messages(events: DataFrame) -> DataFrame:
    """Messages without replies; works on streams too."""
    return events.select(
        F.col("event_id").alias("messageid"), F.col("user_id").alias("channelid"),
        F.expr("concat('ch', user_id)").alias("channelname"),
        F.expr("1 + (event_id % 11) % 4").alias("userid"),
        F.expr("concat('u', 1 + (event_id % 11) % 4)").alias("username"),
        F.col("ts").alias("sent"), F.expr(CONTENT).alias("content"),
        F.lit(None).cast("long").alias("replyid"), F.lit(-1).cast("long").alias("conversid"),
        F.lit(True).alias("isFirstInConvers"))


def messages(spark: SparkSession, sf_dir: str, replies: bool = True,
             cfg: ChatConfig = CFG) -> DataFrame:
    """All messages. Every seventh replies to the third message before it in its channel."""
    plain = as_messages(table(spark, sf_dir, "events"))
    if not replies:
        return plain
    timeline = ordered(plain, ["channelid"], ["sent", "messageid"], cfg.max_group_rows)
    timeline = (timeline.with_previous("p1", "messageid").with_previous("p2", "p1")
                .with_previous("p3", "p2"))
    third = F.when(F.col("messageid") % 7 == 0, F.col("p3.p2.p1.messageid"))
    return timeline.plain().withColumn("replyid", third).drop("p1", "p2", "p3")


def role_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the `conversations` table as messages with known conversations."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("messageid"),
        F.col("conv_id").alias("conversid"), F.try_element_at(role, F.col("role")).alias("userid"),
        F.col("turn").alias("sent"), F.col("text").alias("content"),
        (F.col("turn") == 0).alias("isFirstInConvers"))
