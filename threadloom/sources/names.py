"""Reading names and settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import ChatConfig


def explode_names(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(id, name) pairs from JSON objects, one object per row."""
    return df.select(*keep, F.explode(F.from_json(text, "map<string,string>")).alias("id", "name"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) from JSON files: one object over the whole file, as people write it by hand."""
    return explode_names(spark.read.text(path, wholetext=True), F.col("value"))


def load_config(config_text: str, names_text: str, **options) -> tuple[ChatConfig, list[int]]:
    """Config and channel ids from the two settings texts; ids come as text."""
    settings = json.loads(config_text)
    cfg = ChatConfig(bot_id=int(settings["botID"]), user_id=int(settings["userToImpersonateID"]),
                     names=json.loads(names_text), **options)
    return cfg, [int(channel) for channel in settings["channelIDs"]]
