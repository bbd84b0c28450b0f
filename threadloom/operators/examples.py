"""Training examples and live context: a target message with the lines before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.functions import prompts
from threadloom.operators.conversations import is_assigned
from threadloom.operators.history import with_history
from threadloom.operators.scrub import clean_messages, with_line


HAS_TEXT = "has_text"


def has_text(content: Column) -> Column:
    return F.coalesce(content != "", F.lit(False)).alias(HAS_TEXT)


def training_examples(messages: DataFrame, cfg: ChatConfig, names: DataFrame | None = None,
                      keep: tuple[str, ...] = (), texts: DataFrame | None = None) -> DataFrame:
    """(conversid, messageid, instruction, input, output, *keep) for each reply the member wrote; ``keep``
    may name ``sent`` and ``userid``.

    ``messages`` hold cleaned text and conversations; with ``texts`` (messageid, content) they hold
    ``has_text`` in the text's place. A message is a target when the member wrote it, it has text, it
    does not open its conversation, and some of the ``history`` messages before it have text. Rows are
    found without text, which joins those that examples need.
    """
    flag = has_text(F.col("content")) if texts is None else HAS_TEXT
    rows = messages.filter(is_assigned()).select(
        "messageid", "conversid", "userid", "sent", "isFirstInConvers", flag)
    wanted = (F.col("userid") == cfg.user_id) & F.col(HAS_TEXT) & ~F.col("isFirstInConvers")
    found = with_history(
        rows, ["conversid"], ["sent", "messageid"], is_target=wanted, lookback=cfg.history,
        include_self=False, item="line", max_group_rows=cfg.max_group_rows,
        late=(messages if texts is None else texts).select("messageid", "content"),
        prepare=lambda needed: with_line(needed, cfg, training=True, names=names))
    return found.filter(F.size("history") > 0).select(
        "conversid", "messageid", F.lit(cfg.instruction_text).alias("instruction"),
        F.array_join("history", "\n").alias("input"), F.col("content").alias("output"), *keep)


def is_trigger(cfg: ChatConfig):
    return (F.col("userid") != cfg.bot_id) & F.col("content").startswith(cfg.command)


def chat_triggers(messages: DataFrame, cfg: ChatConfig) -> DataFrame:
    """Messages that call the bot."""
    return messages.filter(is_trigger(cfg)).select("messageid", "channelid", "userid", "sent", "content")


def chat_context(messages: DataFrame, cfg: ChatConfig, names: DataFrame | None = None,
                 asked: Column | None = None) -> DataFrame:
    """(messageid, channelid, context) for each trigger (among ``asked`` rows): the newest ``history`` messages of its
    channel up to the trigger itself, cleaned for live use; empty ones take a place unseen. Text joins
    only the messages that contexts need."""

    def lines(needed: DataFrame) -> DataFrame:
        return with_line(clean_messages(needed, cfg, False, names=names), cfg, False, names=names)

    wanted = F.coalesce(is_trigger(cfg) & (F.lit(True) if asked is None else asked), F.lit(False))
    found = with_history(
        messages.select("messageid", "channelid", "userid", "sent", wanted.alias("_wanted")), ["channelid"],
        ["sent", "messageid"], is_target=F.col("_wanted"), lookback=cfg.history - 1, include_self=True,
        item="line", max_group_rows=cfg.max_group_rows, late=messages.select("messageid", "content"), prepare=lines)
    return found.select("messageid", "channelid", F.array_join("history", "\n").alias("context"))


def render_training(examples: DataFrame) -> DataFrame:
    """(messageid, prompt, completion_start): rendered example and where its scored part starts."""
    instruction, chat = F.col("instruction"), F.col("input")
    return examples.select(
        "messageid", prompts.training_prompt(instruction, chat, F.col("output")).alias("prompt"),
        prompts.completion_start(instruction, chat).alias("completion_start"))


def render_inference(contexts: DataFrame, cfg: ChatConfig) -> DataFrame:
    """(messageid, prompt) for contexts of :func:`chat_context`."""
    return contexts.select(
        "messageid", prompts.inference_prompt(F.lit(cfg.instruction_text), F.col("context")).alias("prompt"))
