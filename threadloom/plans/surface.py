"""The same computations from SQL text: scalar functions for text, table functions for messages.

Functions are temporary ones of the session. Their bodies come from the Column expressions; only the
step that names mentions has a lambda, which has no SQL text, and is written out with the same patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.functions import prompts
from threadloom.functions import text as X
from threadloom.operators.examples import chat_context, training_examples


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_of(spark: SparkSession, expression: Column, columns: str) -> str:
    """SQL text of an expression over these columns; it must be free of lambdas."""
    row = spark.createDataFrame([], columns).select(expression.alias("x"))
    text = row._jdf.queryExecution().analyzed().expressions().head().child().sql()
    # Shown with an error class and a map; SQL takes the message alone.
    return re.sub(r"raise_error\('USER_RAISED_EXCEPTION', map\('errorMessage', (concat\(.*?\)\))\)\)", r"raise_error(\1)", text)


def _define(spark: SparkSession, name: str, arguments: str, result: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def _mentions_sql(text: str, cfg: ChatConfig) -> str:
    before, after = map(quoted, X.MENTION_OF_ID)
    pairs = ", ".join(quoted(x) for pair in cfg.names.items() for x in pair)
    listed = f"try_element_at(map({pairs}), id)" if pairs else "NULL"
    name = f"replace(replace(coalesce({listed}, ''), '\\\\', '\\\\\\\\'), '$', '\\\\$')"
    return (f"aggregate(regexp_extract_all({text}, {quoted(X.MENTION)}, 1), {text}, "
            f"(t, id) -> regexp_replace(t, concat({before}, id, {after}), {name}))")


def register_text(spark: SparkSession, cfg: ChatConfig) -> None:
    """chat_clean, chat_clean_live(content, author); chat_line, chat_line_live(author, content), null
    for empty text; chat_prompt(instruction, input) and chat_training_prompt(instruction, input, output)."""
    text = "content string, author bigint"
    content, author = F.col("content"), F.col("author")
    for name, step in (("chat_strip_urls", X.strip_urls), ("chat_strip_emoji", X.strip_emoji), ("chat_collapse", X.collapse_spaces)):
        _define(spark, name, "content STRING", "STRING", sql_of(spark, step(content), "content string"))
    _define(spark, "chat_mentions", "content STRING", "STRING", _mentions_sql("content", cfg))
    for ending, training in (("", True), ("_live", False)):
        _define(spark, f"chat_chosen{ending}", "content STRING, author BIGINT", "STRING",
                sql_of(spark, X.chosen_text(content, author, cfg, training), text))
        _define(spark, f"chat_clean{ending}", "content STRING, author BIGINT", "STRING",
                f"chat_collapse(chat_mentions(chat_strip_emoji(chat_strip_urls(chat_chosen{ending}(content, author)))))")
        listed = F.try_element_at(X.names_map(cfg.names), author.cast("string"))
        line = F.when(content != "", X.format_line(X.author_name(author, listed, cfg, training), content))
        _define(spark, f"chat_line{ending}", "author BIGINT, content STRING", "STRING", sql_of(spark, line, text))
    parts = [F.col(c) for c in ("instruction", "input", "output")]
    _define(spark, "chat_prompt", "instruction STRING, input STRING", "STRING",
            sql_of(spark, prompts.inference_prompt(*parts[:2]), "instruction string, input string"))
    _define(spark, "chat_training_prompt", "instruction STRING, input STRING, output STRING", "STRING",
            sql_of(spark, prompts.training_prompt(*parts), "instruction string, input string, output string"))


def register_tables(spark: SparkSession, prepared: DataFrame, raw: DataFrame, cfg: ChatConfig) -> None:
    """chat_examples(first, last): training examples of the conversations in this range of ids, from
    ``prepared`` messages; chat_contexts(channel): the context of each trigger of a channel, from ``raw``
    ones. Null arguments stand for all."""
    training_examples(prepared, cfg).createOrReplaceTempView("chat_example_rows")
    chat_context(raw, cfg).createOrReplaceTempView("chat_context_rows")
    _define(spark, "chat_examples", "first BIGINT, last BIGINT",
            "TABLE(conversid BIGINT, messageid BIGINT, instruction STRING, input STRING, output STRING)",
            "SELECT conversid, messageid, instruction, input, output FROM chat_example_rows"
            " WHERE (first IS NULL OR conversid >= first) AND (last IS NULL OR conversid <= last)")
    _define(spark, "chat_contexts", "channel BIGINT", "TABLE(messageid BIGINT, channelid BIGINT, context STRING)",
            "SELECT messageid, channelid, context FROM chat_context_rows WHERE channel IS NULL OR channelid = channel")
