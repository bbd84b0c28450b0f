"""Storing and loading training examples as JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.schema import EXAMPLE


def write_examples(examples: DataFrame, path: str) -> None:
    examples.write.json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAMPLE).json(path)
