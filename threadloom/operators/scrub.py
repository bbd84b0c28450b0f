"""Cleaning and formatting whole message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.functions import text as X
from threadloom.operators.skew import hot_join


def names_table(df: DataFrame, cfg: ChatConfig) -> DataFrame:
    return df.sparkSession.createDataFrame(list(cfg.names.items()), "id string, name string")


def _one_name_each(names: DataFrame) -> DataFrame:
    """The first name in text order where an id is given more than once."""
    return names.groupBy(F.col("id").cast("string").alias("id")).agg(F.min("name").alias("name"))


SALTS = 64


def with_mention_names(df: DataFrame, text: Column, names: DataFrame, unique: str,
                       out: str = "_names") -> DataFrame:
    """Adds a map with the names of the ids mentioned in ``text``, found by a join.

    ``names`` may be of any size. A name is looked up once per id and salt of the message, and the
    mentions of an id meet their copies of it by both: an id in a third of all messages is
    spread over ``SALTS`` tasks, and both sides of that join are plain exchanges.
    """
    salt = F.pmod(F.xxhash64(unique), F.lit(SALTS)).alias("_salt")
    asked = df.select(unique, salt, F.explode(F.array_distinct(X.mention_ids(text))).alias("id"))
    known = asked.select("id", "_salt").distinct().join(_one_name_each(names), "id")
    found = (asked.join(known, ["id", "_salt"]).groupBy(unique)
             .agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias(out)))
    return df.join(found, unique, "left").withColumn(out, F.coalesce(out, X.names_map({})))


def clean_messages(messages: DataFrame, cfg: ChatConfig, training: bool, out: str = "content",
                   names: DataFrame | None = None) -> DataFrame:
    """Messages with scrubbed text in ``out``: commands and bot text blanked (training) or
    rewritten (live), then links and custom emoji removed, mentions named, white space tidied.

    The names of the config become a literal. ``names`` (id, name), a table of any size, takes
    their place and is joined; both give the same.
    """
    # A column per step: a step used twice would be evaluated twice inside one expression.
    text = F.col("_text")
    steps = (messages.withColumn("_text", X.chosen_text(F.col("content"), F.col("userid"), cfg, training))
             .withColumn("_text", X.strip_urls(text)).withColumn("_text", X.strip_emoji(text)))
    if names is None:
        listed = X.names_map(cfg.names)
    else:
        steps = with_mention_names(steps, text, names, "messageid")
        listed = F.col("_names")
    resolved = X.replace_ids(text, F.col("_ids"), listed)
    return steps.withColumn("_ids", X.mention_ids(text)).withColumn(out, X.collapse_spaces(resolved)).drop("_text", "_ids", "_names")


def with_line(messages: DataFrame, cfg: ChatConfig, training: bool, out: str = "line",
              names: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: ``Name: text``, null where the text is empty."""
    author, content = F.col("userid"), F.col("content")
    if names is None:
        listed = F.try_element_at(X.names_map(cfg.names), author.cast("string"))
        name = X.author_name(author, listed, cfg, training)
        return messages.withColumn(out, F.when(content != "", X.format_line(name, content)))
    listed = _one_name_each(names).select(F.col("id").alias("_id"), F.col("name").alias("_listed"))
    name = X.author_name(author, F.col("_listed"), cfg, training)
    joined = hot_join(messages.withColumn("_id", author.cast("string")), listed, "_id", cfg.max_group_rows, "left")
    return joined.withColumn(out, F.when(content != "", X.format_line(name, content))).drop("_id", "_listed")


def format_messages(messages: DataFrame, cfg: ChatConfig, training: bool,
                    names: DataFrame | None = None) -> DataFrame:
    """(messageid, line) of the messages that hold text."""
    return (with_line(messages, cfg, training, names=names)
            .filter(F.col("line").isNotNull()).select("messageid", "line"))


def clean_flags(messages: DataFrame, cfg: ChatConfig, names: DataFrame | None = None) -> DataFrame:
    """Messages with ``is_empty`` and ``is_changed`` telling what training cleaning did."""
    cleaned = clean_messages(messages, cfg, True, "_clean", names)
    empty = F.col("_clean") == ""
    return (cleaned.withColumn("is_empty", empty)
            .withColumn("is_changed", ~empty & (F.col("_clean") != F.col("content"))).drop("_clean"))
