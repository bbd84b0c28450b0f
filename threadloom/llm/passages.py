"""Texts that share a passage of so many words in a row with another text, whatever its bytes.

The work is reduced as in ``repeats``, over words instead of bytes: an anchor (the smallest hash of
``core`` words in each window of ``words`` words) stands for all windows around it. Where runs around
a core are equal, by digests of their bytes, the texts share them. Windows are compared one by one,
by digests again, only around cores that also stand in a text not yet known to share anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.anchors import Hashes, digests, pairs, sliding_min
from threadloom.storage import materialize

PART_WORDS = 1 << 17  # longer texts are taken in parts that overlap by a window less one
_PLACE = 28
# The class digest as two numbers, which Spark aggregates without sorting.
ROWS = "key binary, size int, lo int, hi int, core long, kind long, kind2 long"
KIND = ["core", "kind", "kind2"]


def _bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends; words are parted by one space."""
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    return np.r_[0, gaps + 1], np.r_[gaps, len(data)]


def word_anchors(texts: list[bytes], words: int, core: int):
    """(text, first start, last start, core hash, class digest) of every anchor of texts that have
    ``words`` words at least, parted by one space; one of each class of a text. Starts count words."""
    n = np.array([t.count(b" ") + 1 for t in texts], np.int64)
    data = b" ".join(texts)
    start, end = _bounds(data)
    text = np.repeat(np.arange(len(texts)), n)
    first = Hashes(np.frombuffer(data, np.uint8), 0)
    value = first.of(start[:len(start) - core + 1], end[core - 1:])
    low = np.uint64((1 << _PLACE) - 1)
    packed = (value & ~low) | (low - np.arange(len(value), dtype=np.uint64))
    least = sliding_min(packed, words - core + 1)
    at = np.flatnonzero(text[:len(least)] == text[words - 1:])
    place = (low - (least[at] & low)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    lo, hi, place = at[new], at[np.r_[new[1:], len(at)] - 1], place[new]
    classes = pairs(digests(data, start[lo], end[hi + words - 1], place - lo))
    text, value = text[lo], value[place].view(np.int64)
    order = np.lexsort((classes[:, 1], classes[:, 0], value, text))
    same = np.column_stack([text, value, classes])[order]
    one = order[np.r_[True, (same[1:] != same[:-1]).any(1)]]
    base = np.cumsum(n) - n
    return text[one], (lo - base[text])[one], (hi - base[text])[one], value[one], classes[one]


def _parts(data: list[bytes], words: int):
    """Batches of (index, offset, text) of the texts, of about ``PART_WORDS`` words, parted by one space."""
    batch, total = [], 0
    for i, text in enumerate(data):
        found = text.split()
        for at in range(0, len(found) - words + 1, PART_WORDS):
            part = found[at:at + PART_WORDS + words - 1]
            if batch and total + len(part) > PART_WORDS:
                yield batch
                batch, total = [], 0
            batch.append((i, at, b" ".join(part)))
            total += len(part)
    if batch:
        yield batch


def anchor_rows(texts: DataFrame, words: int, core: int) -> DataFrame:
    """``ROWS`` of every anchor of (key, size, data)."""
    def run(batches):
        for batch in batches:
            key, size, data = batch.columns
            for parts in _parts(data.to_pylist(), words):
                i, at = (np.array([p[c] for p in parts]) for c in (0, 1))
                text, lo, hi, value, kind = word_anchors([p[2] for p in parts], words, core)
                of = pa.array(i[text])
                ints = [pa.array((x + at[text]).astype(np.int32)) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([key.take(of), size.take(of), *ints, *map(pa.array, (value, kind[:, 0], kind[:, 1]))],
                                                 ["key", "size", "lo", "hi", *KIND])

    return texts.mapInArrow(run, ROWS)


def open_passages(texts: DataFrame, words: int, core: int) -> tuple[DataFrame, DataFrame]:
    """(key, size) of texts known to share a passage, and (key, size, runs) of those whose windows
    have to be compared, of texts (key, size, data), a row per document."""
    rows = materialize(anchor_rows(texts, words, core), "word-anchors")
    # Written before they are joined, as in ``repeats``, so that Spark may split a hot core.
    mixed = (F.min("kind") != F.max("kind")) | (F.min("kind2") != F.max("kind2"))
    cores = materialize(rows.groupBy("core").agg(F.count("*").alias("n"), mixed.alias("mixed")).filter("n > 1").drop("n"), "word-cores")
    rows = materialize(rows.join(cores, "core"), "repeated-word-anchors")
    kinds = materialize(rows.filter("mixed").groupBy(*KIND)
                        .agg(F.count("*").alias("times"), F.min(F.struct("key", "size", "lo", "hi")).alias("at")), "word-runs")
    often = kinds.filter("times > 1").select(*KIND)
    sure = rows.filter("not mixed").unionByName(rows.filter("mixed").join(often, KIND, "left_semi").select(rows.columns))
    sure = materialize(sure.select("key", "size").distinct(), "sharing-texts")
    unsure = materialize(rows.filter("mixed").join(sure, ["key", "size"], "left_anti").select("core").distinct(), "open-cores")
    wanted = (kinds.join(unsure, "core", "left_semi").groupBy("at.key", "at.size")
              .agg(F.collect_list(F.struct("at.lo", "at.hi")).alias("runs")))
    return sure, materialize(wanted, "open-runs")


def shared_windows(asked: DataFrame, words: int) -> DataFrame:
    """(key, size) of the texts that share a window in their runs, of (key, size, data, runs), a row per text."""
    def run(batches):
        for batch in batches:
            for key, size, data, runs in zip(*(batch.column(n).to_pylist() for n in ("key", "size", "data", "runs"))):
                data = b" ".join(data.split())
                start, end = _bounds(data)
                at = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in runs]))
                same = np.unique(pairs(digests(data, start[at], end[at + words - 1], np.zeros(len(at), np.int64))), axis=0)
                n = len(same)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.binary()), pa.array(np.full(n, size, np.int32)), *map(pa.array, same.T.copy())],
                                                 ["key", "size", *same_as])

    same_as = ["same", "same2"]
    windows = materialize(asked.select("key", "size", "data", "runs").mapInArrow(run, "key binary, size int, same long, same2 long"), "word-windows")
    twice = materialize(windows.groupBy(*same_as).count().filter("count > 1").select(*same_as), "shared-windows")
    return windows.join(twice, same_as, "left_semi").select("key", "size").distinct()
