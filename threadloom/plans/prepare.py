"""From raw messages to examples: the steps put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.operators.conversations import assign_conversations
from threadloom.operators.examples import has_text, training_examples
from threadloom.operators.scrub import clean_messages
from threadloom.storage import materialize


def with_conversations(messages: DataFrame, cfg: ChatConfig, channels: DataFrame | None = None) -> DataFrame:
    """Messages with assigned conversations; those outside the listed channels are left out."""
    assigned = assign_conversations(messages, cfg, channels).drop("channelid")
    return messages.drop("conversid", "isFirstInConvers").join(assigned, "messageid")


def prepared_messages(messages: DataFrame, cfg: ChatConfig, channels: DataFrame | None = None,
                      names: DataFrame | None = None) -> DataFrame:
    """The stored state examples are made from: text cleaned once, from the raw text, and
    conversations assigned. Stored, since examples read it more than once."""
    cleaned = clean_messages(messages, cfg, training=True, names=names)
    return materialize(with_conversations(cleaned, cfg, channels), "prepared")


def prepare_examples(messages: DataFrame, cfg: ChatConfig, channels: DataFrame | None = None,
                     names: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Training examples straight from raw messages.

    Text is cleaned once and written where it was read. Conversations, and the rows examples need, are
    found from the other columns and a flag for text.
    """
    texts = materialize(clean_messages(messages, cfg, training=True, names=names)
                        .select("messageid", "userid", "sent", "content", has_text(F.col("content"))), "cleaned")
    assigned = assign_conversations(messages, cfg, channels).drop("channelid")
    rows = materialize(texts.drop("content").join(assigned, "messageid"), "prepared")
    return training_examples(rows, cfg, names, keep, texts=texts)
