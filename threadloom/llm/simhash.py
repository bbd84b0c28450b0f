"""Near duplicates by SimHash, linked through one-wildcard variants of fingerprint segments.

Fingerprints at most ``max_bits`` apart are cut into so many segments that one of them differs in
one bit at most (``max_bits`` 4: three). Each segment is indexed once per bit with that bit left
out, so two fingerprints that differ there in nothing else share a key. Keys are joined by
equality and the candidates verified over all 64 bits.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ship
from threadloom.llm.graph import components
from threadloom.storage import materialize

SHORT_RUN = 24


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over the shingles of ``width`` words; 0 for a text without words."""
    # bytes.lower() and bytes.split() work on ASCII letters and ASCII white space alone.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    width = min(width, len(words))
    spans = list(zip(starts, ends[width - 1:]))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), 65_536):
        digests = b"".join([xxhash.xxh64_digest(joined[s:e - 1], seed) for s, e in spans[at:at + 65_536]])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, fp) of every row, fp as a signed long. Null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(len(names))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*names, "fp"])

    names = [id_col, *keep]
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, F.col(text_col).alias("_text_")).mapInArrow(run, f"{kinds}, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs in one bit at most."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, since bitwise_count goes by the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _near_pairs(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among ``fps``; not all pairs."""
    left, links = fps, []
    while left.size:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            x = todo.pop()
            near = _distance(left, x) <= max_bits
            links += [(int(x), int(y)) for y in left[near]]
            todo += list(left[near])
            left = left[~near]
    return links


def _links_of_runs(key: np.ndarray, fp: np.ndarray, max_bits: int):
    """Links among rows of equal keys; rows are sorted by key."""
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
    size = np.diff(np.r_[start, len(key)])
    run = np.repeat(np.arange(len(start)), size)
    short = (size <= SHORT_RUN)[run]
    k, f, r = np.flatnonzero(short), fp[short], run[short]
    a, b = [], []
    for step in range(1, min(SHORT_RUN, len(k))):
        pair = np.flatnonzero(r[step:] == r[:-step])
        if not pair.size:
            break
        near = pair[_distance(f[pair], f[pair + step]) <= max_bits]
        a.append(f[near])
        b.append(f[near + step])
    for i in np.flatnonzero(size > SHORT_RUN):
        if links := _near_pairs(fp[start[i]:start[i] + size[i]], max_bits):
            x, y = np.array(links, np.int64).T
            a.append(x)
            b.append(y)
    return np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])


def fingerprint_links(fps: DataFrame, max_bits: int = 4, cell_rows: int = 20_000) -> DataFrame:
    """(a, b): links between different values of the long column ``fp``; every two fingerprints at
    most ``max_bits`` apart are connected by such links.

    A key shared by more than ``cell_rows`` fingerprints is dealt into chunks, and every two of
    its chunks meet in a task of their own, so no task holds more than about twice that many.
    """
    ship(fps.sparkSession)
    fps = materialize(fps.select("fp").distinct(), "fingerprints")
    parts = segments(max_bits)
    fp = F.col("fp")
    value = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in parts]
    # A key has the rows of two exact segment values, so a large key shows in their counts.
    counts = (fps.select(F.posexplode(F.array(*value)).alias("part", "value"))
              .groupBy("part", "value").count().filter(F.col("count") > cell_rows // 2))
    bits = F.when(F.col("part") == 0, F.lit(parts[0][1]))
    for i, (_, n) in enumerate(parts[1:], 1):
        bits = bits.when(F.col("part") == i, F.lit(n))
    large = (counts.withColumn("bit", F.explode(F.sequence(F.lit(0), bits - 1)))
             .withColumn("rest", F.col("value").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)"))))
             .groupBy("part", "bit", "rest").agg((F.floor(2 * F.sum("count") / cell_rows) + 1).cast("int").alias("chunks")))
    keys = [F.struct(F.lit(i).alias("part"), F.lit(bit).alias("bit"),
                     v.bitwiseAND(F.lit(~(1 << bit))).alias("rest"))
            for i, (v, (_, n)) in enumerate(zip(value, parts)) for bit in range(n)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    rows = rows.join(large, ["part", "bit", "rest"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, own) * F.col("chunks") + F.greatest(c, own)))
    rows = rows.select((F.col("part") * 64 + F.col("bit")).cast("long").alias("place"), "rest",
                       F.explode(cells).alias("cell"), "fp").withColumn("cell", F.col("cell").cast("long"))
    dealt = rows.select("place", "rest", "cell", "fp").repartition("place", "rest", "cell").sortWithinPartitions("place", "rest", "cell")

    def run(batches):
        tail = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = x if tail is None else np.concatenate([tail, x])
            cut = len(x)
            while cut and (x[cut - 1, :3] == x[-1, :3]).all():
                cut -= 1
            tail = x[cut:]
            if cut:
                a, b = _links_of_runs(x[:cut, :3], x[:cut, 3], max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if tail is not None and len(tail):
            a, b = _links_of_runs(tail[:, :3], tail[:, 3], max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", cell_rows: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, fp, component_id, component) of every row, component_id being the smallest id
    reachable, and component the smallest fingerprint of the component, which no other one shares.

    Texts that are null, empty or without words have fingerprint 0 and are linked like any other.
    Repeated rows and ids stay as they are; a null id is left out of the minimum, and a component
    of null ids alone has a null id. An empty table gives no rows. Other columns are not read.
    """
    prints = materialize(with_fingerprint(docs, width, id_col, text_col, keep), "simhash")
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = materialize(components(fingerprint_links(prints, max_bits, cell_rows)), "components")
    of_root = (least.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root")
               .agg(F.min("least").alias("reached")))
    linked = roots.join(of_root, "root").select(F.col("node").alias("fp"), "reached", "root")
    classes = least.join(linked, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id"),
                                                      F.coalesce("root", "fp").alias("component"))
    # Written, so that the join shuffles both sides for itself and Spark may split a hot fingerprint.
    return prints.join(materialize(classes, "classes"), "fp").select(id_col, *keep, "fp", "component_id", "component")


def hex_fingerprint(fp=None):
    return F.lower(F.lpad(F.hex("fp" if fp is None else fp), 16, "0"))
