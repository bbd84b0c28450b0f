"""Conversation assignment.

Messages of a channel are read in order of (sent, messageid). A message opens a new conversation
when it is the channel's first, or when it is no reply and its anchor lies more than the gap
back. The anchor is the last message before the author's current run of messages, or the last
break inside that run. A reply joins its target's conversation and takes the messages after it
along. Everything else joins the conversation of the message before.

How this becomes joins and windows:

1. ``lag`` finds the certain breaks (no reply, and more than the gap after the message before)
   and the points where the anchor is known whatever came earlier: first message, certain break,
   change of author. These cut a channel into pieces.
2. Inside a piece only messages more than the gap after the piece's anchor can break, and they do
   so by greedy thinning. Breaks of a channel are more than the gap apart, so there are few.
3. Breaks and replies are heads; every message belongs to the head before it.
4. Each reply head points to its target's head. Following these pointers ends at a break.
5. Breaks are numbered in order; a message takes the number its head leads to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.config import UNASSIGNED, ChatConfig
from threadloom.functions.times import micros, to_micros
from threadloom.operators.ordered import Ordered, group_sizes, ordered, with_row_index
from threadloom.operators.replies import resolve_roots, with_target
from threadloom.operators.skew import has_hot_key, hot_join
from threadloom.operators.thinning import greedy_thin
from threadloom.storage import materialize

ORDER = ["t", "messageid"]


def is_assigned() -> Column:
    return F.coalesce(F.col("conversid") != UNASSIGNED, F.lit(False))


def _timeline(messages: DataFrame, cfg: ChatConfig) -> Ordered:
    """The few columns assignment reads, per channel in time order, replies resolved."""
    rows = messages.select(
        "messageid", "channelid", "userid", "replyid", micros(messages, "sent").alias("t"),
        F.when(is_assigned(), F.col("conversid")).alias("known"), is_assigned().alias("assigned"))
    sizes = group_sizes(messages, ["channelid"])
    # A target may be answered from many channels, or be gone, so the reply ids are counted themselves.
    hot = sizes[1] > cfg.max_group_rows and has_hot_key(rows.filter(~F.col("assigned")), "replyid", cfg.max_group_rows)
    rows = with_target(rows, cfg.on_missing_reply, hot=hot, max_key_rows=cfg.max_group_rows).drop("replyid")
    return ordered(rows, ["channelid"], ORDER, cfg.max_group_rows, sizes)


def _breaks(messages: DataFrame, cfg: ChatConfig) -> Ordered:
    """Timeline with ``is_break``."""
    gap = to_micros(cfg.gap)
    timeline = _timeline(messages, cfg).with_previous("prev", "userid", "t", "assigned")
    assigned, t = F.col("assigned"), F.col("t")
    first = F.col("prev").isNull()
    certain = F.col("target").isNull() & (t - F.col("prev.t") > gap)
    new_run = F.col("prev.assigned") | (F.col("userid") != F.col("prev.userid"))
    rows = timeline.rows.withColumn("certain", ~assigned & (first | certain))
    anchor = F.when(assigned | F.col("certain"), t).when(new_run, F.col("prev.t"))
    pieces = (
        timeline.with_rows(rows)
        .with_running_last("piece", F.when(
            anchor.isNotNull(), F.struct(anchor.alias("anchor"), F.col("messageid").alias("id")))))
    pieces = pieces.with_rows(pieces.rows.select(
        "messageid", "channelid", "t", "target", "known", "assigned", "certain",
        F.col("piece.anchor").alias("anchor"), F.col("piece.id").alias("piece"),
        *(["_chunk"] if pieces.split else []))).materialized("pieces")

    can_break = (~assigned & ~F.col("certain") & F.col("target").isNull()
                 & (t - F.col("anchor") > gap))
    kept = greedy_thin(pieces.rows.filter(can_break).select("piece", "t", "messageid"),
                       ["piece"], gap, max_group_rows=cfg.max_group_rows)
    rows = (pieces.rows.join(kept.withColumn("_late", F.lit(True)), "messageid", "left")
            .withColumn("is_break", F.col("certain") | F.col("_late").isNotNull())
            .drop("_late", "anchor", "piece", "certain"))
    return pieces.with_rows(rows)


def conversation_breaks(messages: DataFrame, cfg: ChatConfig) -> DataFrame:
    """(messageid, channelid, is_break) for messages not yet assigned."""
    return (_breaks(messages, cfg).rows.filter(~F.col("assigned"))
            .select("messageid", "channelid", "is_break"))


def _segments(messages: DataFrame, cfg: ChatConfig) -> Ordered:
    timeline = _breaks(messages, cfg)
    is_root = F.col("is_break") | F.col("assigned")
    head = F.when(is_root | F.col("target").isNotNull(),
                  F.struct(F.col("messageid").alias("id"), is_root.alias("is_root")))
    return timeline.with_running_last("head", head)


def conversation_heads(messages: DataFrame, cfg: ChatConfig) -> DataFrame:
    """(messageid, channelid, head): the break or reply each message follows on from."""
    return _segments(messages, cfg).rows.filter(~F.col("assigned")).select(
        "messageid", "channelid", F.col("head.id").alias("head"))


def in_channels(messages: DataFrame, channels: DataFrame | None) -> DataFrame:
    """Messages of the listed channels; all of them without a list."""
    return messages if channels is None else messages.join(channels.select("channelid"), "channelid", "left_semi")


def max_conversation(messages: DataFrame) -> DataFrame:
    """One row: the largest conversation id, -1 when there is none."""
    return messages.agg(F.coalesce(F.max("conversid"), F.lit(UNASSIGNED)).cast("long").alias("max_conversid"))


def assign_conversations(messages: DataFrame, cfg: ChatConfig, channels: DataFrame | None = None,
                         first_id: int | None = None) -> DataFrame:
    """(messageid, channelid, conversid, isFirstInConvers) for messages not yet assigned.

    New ids follow the largest one in use (or start at ``first_id``) in channel order, then time;
    ``channels`` (ordinal, channelid) gives the channels and their order, by default all channels
    by id. Assigned rows only provide context.
    """
    if first_id is None:
        first_id = max_conversation(messages).first()["max_conversid"] + 1
    timeline = _segments(in_channels(messages, channels), cfg)
    segments = materialize(timeline.rows.select(
        "messageid", "channelid", "t", "target", "known", "assigned", "is_break",
        F.col("head.id").alias("head"), F.col("head.is_root").alias("head_is_root")), "segments")

    breaks = segments.filter("is_break").select("channelid", "t", "messageid")
    if channels is None:
        numbered = with_row_index(breaks, ["channelid", *ORDER], "n")
    else:
        once = channels.groupBy("channelid").agg(F.min("ordinal").alias("ordinal"))
        numbered = with_row_index(breaks.join(once, "channelid"), ["ordinal", *ORDER], "n")
    roots = (numbered.select(F.col("messageid").alias("root"), (F.col("n") + first_id).alias("conversid"))
             .unionByName(segments.filter("assigned").select(
                 F.col("messageid").alias("root"), F.col("known").alias("conversid"))))

    # Usable targets and heads are of the message's own channel, so only a large channel can hold
    # one that many messages share.
    def join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        return hot_join(left, right, key, cfg.max_group_rows, hot=timeline.split)

    links = join(
        segments.filter(F.col("target").isNotNull() & ~F.col("is_break"))
        .select(F.col("messageid").alias("child"), "target"),
        segments.select(F.col("messageid").alias("target"), F.col("head").alias("parent"),
                        F.col("head_is_root").alias("done")), "target")
    children = resolve_roots(links.select("child", "parent", "done"), join)
    heads = (join(children, roots, "root").select(F.col("child").alias("head"), "conversid")
             .unionByName(roots.withColumnRenamed("root", "head")))
    return (join(segments.filter(~F.col("assigned")), heads, "head")
            .select("messageid", "channelid", "conversid", F.col("is_break").alias("isFirstInConvers")))


def assign_new(new: DataFrame, prior: DataFrame, cfg: ChatConfig,
               channels: DataFrame | None = None) -> DataFrame:
    """Assign ``new`` messages next to ``prior`` ones that keep their conversations.

    Of the prior messages only those matter that new ones touch: per channel with news, the last
    one before the first new message and any later one, and every reply target.
    """
    columns = ["messageid", "channelid", "userid", "sent", "replyid", "conversid"]
    new = in_channels(new.select(*columns), channels).withColumn("conversid", F.lit(UNASSIGNED).cast("long"))
    prior = prior.select(*columns).filter(is_assigned())
    starts = new.groupBy("channelid").agg(F.min(F.struct("sent", "messageid")).alias("_start"))
    beside = hot_join(prior, starts, "channelid", cfg.max_group_rows, "left")
    at = F.struct("sent", "messageid")
    # One pass over the prior messages gives the last row of each channel and the largest id.
    before = F.when(at < F.col("_start"), at)
    ends = materialize(beside.groupBy("channelid").agg(
        F.max("conversid").alias("conversid"), F.max_by(F.struct(*columns), before).alias("_row"),
        F.max(before).alias("_before")), "ends")
    first_id = max_conversation(ends).first()["max_conversid"] + 1
    last = ends.filter(F.col("_before").isNotNull()).select("_row.*")
    # A second one the rows late messages come before, and the reply targets.
    asked = new.select(F.col("replyid").alias("messageid"), F.lit(True).alias("_asked")).filter("messageid IS NOT NULL").distinct()
    seen = beside.join(asked, "messageid", "left").filter((at >= F.col("_start")) | F.col("_asked")).select(*columns)
    touched = materialize(new.unionByName(seen.unionByName(last).dropDuplicates(["messageid"])), "touched")
    return assign_conversations(touched, cfg, channels, first_id)


def author_runs(messages: DataFrame, cfg: ChatConfig) -> DataFrame:
    """(messageid, channelid, run, anchor_sent): runs of one author per channel, counted from 1,
    and the time of the message before the run."""
    timeline = ordered(messages.select("messageid", "channelid", "userid", "sent"), ["channelid"],
                       ["sent", "messageid"], cfg.max_group_rows).with_previous("prev", "userid", "sent")
    starts = F.col("prev").isNull() | (F.col("userid") != F.col("prev.userid"))
    runs = (timeline.with_running_count("run", starts)
            .with_running_last("start", F.when(starts, F.struct(F.col("prev.sent").alias("sent")))))
    return runs.rows.select("messageid", "channelid", "run", F.col("start.sent").alias("anchor_sent"))


def prev_message(messages: DataFrame, cfg: ChatConfig) -> DataFrame:
    """Each message with id, author and time of the one before it in the channel."""
    timeline = ordered(messages.select("messageid", "channelid", "userid", "sent"), ["channelid"],
                       ["sent", "messageid"], cfg.max_group_rows)
    return timeline.with_previous("prev", "messageid", "userid", "sent").rows.select(
        "messageid", "channelid", F.col("prev.messageid").alias("prev_messageid"),
        F.col("prev.userid").alias("prev_userid"), F.col("prev.sent").alias("prev_sent"))


def conversation_position(messages: DataFrame, cfg: ChatConfig) -> DataFrame:
    """0-based position of each assigned message in its conversation."""
    rows = messages.filter(is_assigned()).select("messageid", "conversid", "sent")
    return (ordered(rows, ["conversid"], ["sent", "messageid"], cfg.max_group_rows)
            .with_position("position").rows.select("messageid", "conversid", "position"))
