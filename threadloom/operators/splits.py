"""Cross-validation folds and a held-out split over a numbered table."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.config import FOLDS, TEST_SHARE
from threadloom.operators.ordered import with_row_index
from threadloom.storage import materialize


def percent_boundary(rows: int, percent: int) -> int:
    """Row number of a percentage, halves rounded to even."""
    return round(Fraction(rows * percent, 100))


def own_fold(index: Column, rows: int, folds: int = FOLDS) -> Column:
    """The fold whose validation slice holds the row."""
    bounds = [percent_boundary(rows, 100 * k // folds) for k in range(1, folds)]
    return sum((F.when(index >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def with_own_fold(examples: DataFrame, order: list[str], folds: int = FOLDS) -> DataFrame:
    """Adds ``row_index`` and ``own_fold``: contiguous validation slices in ``order``."""
    # Numbering reads its input twice, so the examples are written first.
    indexed = with_row_index(materialize(examples, "examples"), order)
    return indexed.withColumn("own_fold", own_fold(F.col("row_index"), indexed.count(), folds))


def fold(folded: DataFrame, k: int, split: str) -> DataFrame:
    """Validation (``"val"``) or training (``"train"``) rows of fold ``k``, no copy made."""
    mine = F.col("own_fold") == k
    return folded.filter(mine if split == "val" else ~mine)


def kfold_split(folded: DataFrame, folds: int = FOLDS, unique: str = "messageid") -> DataFrame:
    """(fold, split, id): every row once per fold, one of them for validation."""
    rows = folded.select(unique, "own_fold", F.explode(F.array(*map(F.lit, range(folds)))).alias("fold"))
    split = F.when(F.col("fold") == F.col("own_fold"), "val").otherwise("train")
    return rows.select("fold", split.alias("split"), unique)


def kfold_sizes(folded: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(fold, split, rows), counted before the copies are made."""
    own = folded.groupBy("own_fold").agg(F.count("*").alias("n"))
    rows = own.select("n", "own_fold", F.explode(F.array(*map(F.lit, range(folds)))).alias("fold"))
    split = F.when(F.col("fold") == F.col("own_fold"), "val").otherwise("train")
    return rows.groupBy("fold", split.alias("split")).agg(F.sum("n").alias("rows"))


def random_split(examples: DataFrame, key: Column, unique: str = "messageid",
                 test_share: float = TEST_SHARE) -> DataFrame:
    """(id, split): the rows with the smallest ``key`` are for test, exactly ``test_share`` of
    them rounded up. ``key`` should be pseudo-random, such as a seeded hash."""
    indexed = with_row_index(materialize(examples.select(unique, key.alias("_key")), "keys"), ["_key", unique])
    test_rows = math.ceil(Fraction(str(test_share)) * indexed.count())
    split = F.when(F.col("row_index") < test_rows, "test").otherwise("train")
    return indexed.select(unique, split.alias("split"))
