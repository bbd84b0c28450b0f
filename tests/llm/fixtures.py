"""Small documents with everything odd in them, and words after the contract's patterns."""

from __future__ import annotations

import random
import re
import string

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = ("fp", "key", "w", "hits", "row", "id", "x", "y", "a", "b", "size", "data", "spans", "base", "left", "score", "h", "at", "page", "digest")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def long_text(n, seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choices("aeioun tlrs", k=r.randint(2, 9))) for _ in range(n))


ODD = [(1, None), (None, "Hello there. General"), (None, "Hello there. General"), (2, ""), (3, "word"), (3, "word"), (4, long_text(20_000)),
       (5, "Ünïcode ▁ 😀 text\x00 with\ttabs\n\nand lines"), (6, " "), (7, "a" * 5_000), (8, "1 2 " * 3_000), (9, "Mit License, MIT LICENSE")]


def docs(spark, rows=ODD):
    """doc_id and text, and columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
