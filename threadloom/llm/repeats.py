"""Removal of bytes covered by long strings that stand more than once in the corpus.

A string of ``window`` bytes is removed if it also starts anywhere else, in the same text or in
another. The Burrows-Wheeler merge of ``bwt`` decides that, after two exact reductions that leave it
only what it is needed for (``anchors``):

1. Anchors stand for all windows. A core that occurs once has no repeated window. Where all runs
   around a core are equal (by digests of their bytes), all their windows are repeated.
2. Cores with different runs around them stay: for these one piece of text per different run goes
   to the task of its core. There a longer core decides most of the rest in the same way, and
   shards of the remaining pieces, in which the core is a single letter, are merged.

Copies pre-aggregate as equal runs. A core with more than ``core_rows`` different runs around it is
not given to one task: its windows are counted by digests of their bytes instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.anchors import DIGEST, anchors, digests, pairs
from threadloom.llm.bwt import repeated
from threadloom.llm.common import ship, text_key
from threadloom.llm.passages import open_passages, shared_windows
from threadloom.storage import materialize

BATCH_BYTES = 1 << 20
ROWS = "key binary, size int, place int, lo int, hi int, core long, kind binary"


def _runs(texts: list[bytes]):
    """Consecutive indexes whose texts come to about a batch."""
    run, total = [], 0
    for i, t in enumerate(texts):
        if run and total + len(t) > BATCH_BYTES:
            yield run
            run, total = [], 0
        run.append(i)
        total += len(t)
    if run:
        yield run


def _binary(found: bytes) -> pa.Array:
    """Digests that stand one after another."""
    return pa.Array.from_buffers(pa.binary(DIGEST), len(found) // DIGEST, [None, pa.py_buffer(found)]).cast(pa.binary())


def anchor_rows(texts: DataFrame, window: int, core: int) -> DataFrame:
    """``ROWS`` of every anchor of (key, size, data)."""
    def run(batches):
        for batch in batches:
            key, size, data = batch.columns
            n = [len(x) for x in map(memoryview, map(pa.BinaryScalar.as_buffer, data))]
            start = 0
            while start < len(n):
                stop, total = start, 0
                while stop < len(n) and (stop == start or total + n[stop] <= BATCH_BYTES):
                    total += n[stop]
                    stop += 1
                text, place, lo, hi, c, k = anchors(data.slice(start, stop - start).to_pylist(), window, core)
                text = text + start
                start = stop
                if len(text):
                    ints = [pa.array(x.astype(np.int32)) for x in (place, lo, hi)]
                    of = pa.array(text)
                    yield pa.RecordBatch.from_arrays([key.take(of), size.take(of), *ints, pa.array(c), _binary(k)],
                                                     ["key", "size", "place", "lo", "hi", "core", "kind"])

    return texts.mapInArrow(run, ROWS)


def resolve(pieces: list[bytes], group: np.ndarray, times: np.ndarray, window: int, core: int):
    """(piece, lo, hi): runs of starts of windows that stand more than once in their group, for the
    pieces that stand once; those that stand more often are repeated anyway and only compared with."""
    found = [np.zeros((0, 3), np.int64)]
    text, place, lo, hi, c, k = ([] for _ in range(6))
    for run in _runs(pieces):
        some = [pieces[i] for i in run]
        own, at, a, b, _, kind = anchors(some, window, core)
        begin = np.cumsum([0] + [len(t) for t in some])[own]
        same = digests(b"".join(some), begin + at, begin + at + core, np.zeros(len(at), np.int64))
        for to, x in zip((text, place, lo, hi, c, k), (np.array(run)[own], at, a, b, pairs(same), pairs(kind))):
            to.append(x)
    text, place, lo, hi, c, k = map(np.concatenate, (text, place, lo, hi, c, k))
    _, spot = np.unique(np.column_stack([group[text], c]), axis=0, return_inverse=True)
    classes, first, of = np.unique(np.column_stack([spot, k]), axis=0, return_index=True, return_inverse=True)
    heavy = np.bincount(of, times[text])
    spot_of = classes[:, 0]
    total, kinds = np.bincount(spot_of, heavy), np.bincount(spot_of)
    often = (heavy[of] > 1) & (times[text] == 1)
    found.append(np.stack([text, lo, hi], 1)[often])
    # One row a class of the cores that still have several; the core is one letter of its own.
    rows = first[(total[spot_of] > 1) & (kinds[spot_of] > 1)]
    spots, rank = np.unique(spot[rows], return_inverse=True)
    letters = []  # texts of different cores are never compared, so one letter serves them all
    for r in rows:
        data = np.frombuffer(pieces[text[r]], np.uint8)
        letters.append(np.concatenate([data[lo[r]:place[r]], [256], data[place[r] + core:hi[r] + window]]).astype(np.uint16))
    hit, start = repeated(letters, rank, window - core + 1)
    hit = rows[hit] if len(hit) else hit.astype(np.int64)
    single = (heavy[of[hit]] == 1) & (times[text[hit]] == 1)
    hit, start = hit[single], start[single]
    found.append(np.stack([text[hit], lo[hit] + start, lo[hit] + start], 1))
    return np.concatenate(found)


def _merged(lo, hi, window: int) -> list[tuple[int, int]]:
    """Byte ranges covered by windows that start in the runs, as maximal ranges."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order] + window)
    new = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    return list(zip(lo[new].tolist(), reach[np.r_[new[1:] - 1, len(lo) - 1]].tolist()))


def repeated_ranges(texts: DataFrame, window: int, core: int, inner_core: int, core_rows: int,
                    also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, size, spans) of each text (key, size, data) with repeated strings: sorted, disjoint
    byte ranges. Equal (key, size) stand for equal texts; keys are digests of the bytes.

    The second table holds each text that had to be read again once, with those of ``also`` (key, size).
    """
    ship(texts.sparkSession)
    rows = materialize(anchor_rows(texts, window, core), "anchors")
    # Written, so that the join shuffles both sides for itself and Spark may split a hot core.
    cores = materialize(rows.groupBy("core").agg(F.count("*").alias("n"), F.min("kind").alias("a"), F.max("kind").alias("b"))
                        .filter("n > 1").select("core", (F.col("a") != F.col("b")).alias("mixed")), "cores")
    rows = materialize(rows.join(cores, "core"), "repeated-anchors")
    kinds = materialize(rows.filter("mixed").groupBy("core", "kind").agg(
        F.count("*").alias("times"), F.min(F.struct("key", "size", "lo", "hi", "place")).alias("at")), "runs")
    # Runs that stand more than once are repeated whole; which of the mixed ones do is joined on.
    often = kinds.filter("times > 1").select("core", "kind", F.lit(True).alias("often"))
    sure = rows.filter("not mixed").unionByName(rows.filter("mixed").join(often, ["core", "kind"], "left_semi").select(rows.columns))
    sure = sure.select("key", "size", "lo", "hi").distinct()

    # Written, like the cores above: a text asked for by many cores, or one that stands very often.
    large = kinds.groupBy("core").count().filter(F.col("count") > core_rows).select("core", F.lit(True).alias("large"))
    wanted = (kinds.join(large, "core", "left").groupBy("at.key", "at.size")
              .agg(F.collect_list(F.struct("core", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), "times",
                                           F.coalesce("large", F.lit(False)).alias("large"))).alias("pieces")))
    wanted = materialize(wanted, "wanted")
    # Copies of a text asked for come with it; one is kept, before they meet where Spark combines.
    keys = wanted.select("key", "size")
    keys = keys if also is None else keys.unionByName(also)
    asked = texts.join(keys, ["key", "size"], "left_semi").groupBy("key", "size").agg(F.first("data").alias("data"))
    asked = materialize(asked, "asked-texts")
    pieces = (asked.join(wanted, ["key", "size"])
              .select("key", "size", "data", F.explode("pieces").alias("p"))
              .select("p.core", "p.times", "p.large", "key", "size", "p.lo",
                      F.expr(f"substring(data, p.lo + 1, p.hi - p.lo + {window})").alias("piece")))
    pieces = materialize(pieces, "pieces")

    def run(batches):
        tail = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            tail = t if tail is None else pa.concat_tables([tail, t])
            core_of = tail.column("core").to_numpy()
            cut = int(np.searchsorted(core_of, core_of[-1])) if len(core_of) else 0
            if cut:
                yield from solve(tail.slice(0, cut))
                tail = tail.slice(cut).combine_chunks()
        if tail is not None and tail.num_rows:
            yield from solve(tail)

    def solve(t: pa.Table):
        _, group = np.unique(t.column("core").to_numpy(), return_inverse=True)
        found = resolve(t.column("piece").to_pylist(), group, t.column("times").to_numpy(), window, inner_core)
        if len(found):
            of = pa.array(found[:, 0])
            key, size = (t.column(n).take(of).combine_chunks() for n in ("key", "size"))
            at = t.column("lo").to_numpy()[found[:, 0]]
            yield pa.RecordBatch.from_arrays(
                [key, size, pa.array((at + found[:, 1]).astype(np.int32)), pa.array((at + found[:, 2]).astype(np.int32))], ["key", "size", "lo", "hi"])

    span = "key binary, size int, lo int, hi int"
    merged = (pieces.filter("not large").select("core", "times", "key", "size", "lo", "piece").repartition("core")
              .sortWithinPartitions("core").mapInArrow(run, span))

    def windows(batches):
        for batch in batches:
            for key, size, lo, piece in zip(*(batch.column(n).to_pylist() for n in ("key", "size", "lo", "piece"))):
                at = np.arange(len(piece) - window + 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.binary()), pa.array(np.full(n, size, np.int32)), pa.array((lo + at).astype(np.int32)),
                     _binary(digests(piece, at, at + window, np.zeros(n, np.int64)))], ["key", "size", "lo", "same"])

    hashed = pieces.filter("large").select("key", "size", "lo", "piece").mapInArrow(windows, "key binary, size int, lo int, same binary")
    twice = hashed.groupBy("same").count().filter("count > 1")
    counted = hashed.join(twice, "same").select("key", "size", "lo", F.col("lo").alias("hi"))

    runs = (sure.unionByName(merged).unionByName(counted).groupBy("key", "size")
            .agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")))

    @F.udf("array<struct<start:int,end:int>>", useArrow=True)
    def ranges(lo, hi):
        return _merged(np.array(lo), np.array(hi), window)

    return runs.select("key", "size", ranges("lo", "hi").alias("spans")), asked


def without(data: Column, spans: Column) -> Column:
    """Bytes of ``data`` outside the sorted, disjoint ranges."""
    empty = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    step = lambda a, s: F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.substring(data, a["at"] + 1, s["start"] - a["at"])).alias("out"))
    rest = F.aggregate(spans, empty, step, lambda a: F.concat(a["out"], F.substring(data, a["at"] + 1, F.length(data))))
    return F.when(F.size(spans) > 0, rest).otherwise(data)


def remove_repeats(docs: DataFrame, window: int = 400, core: int = 100, inner_core: int = 320, core_rows: int = 20_000,
                   id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None, passage_core: int = 16) -> DataFrame:
    """(id_col, data, spans, kept) of every row: the text's bytes, the removed ranges (sorted,
    disjoint, maximal; empty if none) and the bytes left.

    With ``passage_words`` there is a column ``shares_passage`` too: whether so many words in a row,
    parted by any ASCII white space, also stand in another row. Nothing is removed for that.

    Null texts count as empty. Texts shorter than ``window`` lose nothing. Repeated rows are copies
    like any others: whole texts of ``window`` bytes or more are removed. Other columns are not read.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias(id_col), data.alias("data"))
    rows = rows.select(id_col, text_key(F.col("data")).alias("key"), F.length("data").alias("size"), "data")
    texts = rows.select("key", "size", "data")
    # A passage has a byte a word and one between two words at least.
    long = F.col("size") >= min(window, window if passage_words is None else 2 * passage_words - 1)
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    if passage_words is None:
        found, _ = repeated_ranges(texts.filter(long), window, core, inner_core, core_rows)
    else:
        ship(docs.sparkSession)
        sure, runs = open_passages(texts.filter(long), passage_words, passage_core)
        found, asked = repeated_ranges(texts.filter(long), window, core, inner_core, core_rows, runs.select("key", "size"))
        shared = sure.unionByName(shared_windows(asked.join(runs, ["key", "size"]), passage_words))
        found = found.join(shared.distinct().withColumn("shares_passage", F.lit(True)), ["key", "size"], "full")
    rows = rows.join(materialize(found, "repeats"), ["key", "size"], "left").withColumn("spans", F.coalesce("spans", empty))
    more = [] if passage_words is None else [F.coalesce("shares_passage", F.lit(False)).alias("shares_passage")]
    return rows.select(id_col, "data", "spans", without(F.col("data"), F.col("spans")).alias("kept"), *more)
