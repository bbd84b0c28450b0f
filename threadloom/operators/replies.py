"""Reply links between messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import MAX_GROUP_ROWS
from threadloom.operators.skew import hot_join
from threadloom.storage import materialize


def reply_join(messages: DataFrame, max_key_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Each reply with its target's channel, author and time; nulls when the target is unknown."""
    target = messages.select(
        F.col("messageid").alias("replyid"), F.col("channelid").alias("target_channelid"),
        F.col("userid").alias("target_userid"), F.col("sent").alias("target_sent"))
    asked = messages.filter(F.col("replyid").isNotNull()).select("messageid", "channelid", "replyid")
    return hot_join(asked, target, "replyid", max_key_rows, "left")


def with_target(rows: DataFrame, on_missing: str = "ignore", time: str = "t", hot: bool = True,
                max_key_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Adds ``target``: the message replied to, if it is an earlier one of the same channel.

    Any other reply has no usable target: with ``"ignore"`` the message counts as no reply, with
    ``"error"`` the job fails. Rows that are no replies keep out of the join, where their null
    keys would all meet in one task. ``hot=False`` says no target has many replies.
    """
    is_reply = F.col("replyid").isNotNull() & ~F.col("assigned")
    others = rows.filter(~is_reply).withColumn("target", F.lit(None).cast("long"))
    known = rows.select(
        F.col("messageid").alias("replyid"), F.col("channelid").alias("_channel"), F.col(time).alias("_t"))
    usable = (F.col("_channel") == F.col("channelid")) & (
        F.struct(F.col("_t"), F.col("replyid")) < F.struct(F.col(time), F.col("messageid")))
    if on_missing == "error":
        otherwise = F.raise_error(F.concat(
            F.lit("no usable reply target for message "), F.col("messageid").cast("string"))).cast("long")
    else:
        otherwise = F.lit(None).cast("long")
    replies = (hot_join(rows.filter(is_reply), known, "replyid", max_key_rows, "left", hot)
               .withColumn("target", F.when(usable, F.col("replyid")).otherwise(otherwise))
               .drop("_channel", "_t"))
    return others.unionByName(replies)


def resolve_roots(links: DataFrame, join: Callable[[DataFrame, DataFrame, str], DataFrame]) -> DataFrame:
    """(child, root) for every row of ``links`` (child, parent, done); ``join`` joins on a key.

    ``done`` says the parent is a root; any other parent is itself a child. Each round lets the
    children not yet done skip to their parent's parent, so a chain of depth d takes about
    log2(d) rounds and only the long chains stay in the loop. Links must not form a cycle.
    """
    pairs = materialize(links, "links")
    finished, active = pairs.filter("done"), pairs.filter(~F.col("done"))
    while not active.isEmpty():
        onward = finished.unionByName(active).select(
            F.col("child").alias("parent"), F.col("parent").alias("_grand"), F.col("done").alias("_done"))
        moved = materialize(
            join(active, onward, "parent")
            .select("child", F.col("_grand").alias("parent"), F.col("_done").alias("done")), "links")
        finished = finished.unionByName(moved.filter("done"))
        active = moved.filter(~F.col("done"))
    return finished.select("child", F.col("parent").alias("root"))
