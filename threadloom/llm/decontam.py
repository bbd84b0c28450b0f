"""Benchmark decontamination as a prefix-filtered set join of shingles.

Every item gives windows of ``window`` consecutive words (a shorter item is one window). A window
is a set of shingles with their offsets, and it occurs in a document only where all of them do, so
one shingle is enough for a prefix: the one rarest in the documents. Windows with a shingle that
no document holds drop out. Places where the prefix shingle stands are joined by equality, bounded
by the window's length and offset, and verified: each shingle must stand at its offset.

Documents are read once. A text's words meet the shingles of the benchmark there and then, word by
word, and leave the number of words and the places of known shingles; everything later works on these
few rows. The joined side is broadcast in slices of at most ``slice_rows`` shingles of a few words,
one pass over the documents for each, so a benchmark of any size is handled alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import text_key, words
from threadloom.storage import materialize

SLICE_ROWS = 200_000


def _starts(n: Column, width: Column) -> Column:
    """0-based places where ``width`` words fit into ``n``; null where none does."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width))


def word_id(part: Column) -> Column:
    """16 bytes that stand for these words; words hold no blanks."""
    return F.unhex(F.md5(F.array_join(part, " ")))


def item_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, win, words, len): the windows of each item, each once."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w"))
    length = F.least(F.size("w"), F.lit(window))
    return (items.withColumn("at", F.explode(F.when(F.size("w") > 0, _starts(F.size("w"), length))))
            .select("item", F.slice("w", F.col("at") + 1, length).alias("words"))
            .select("item", word_id(F.col("words")).alias("win"), "words", F.size("words").alias("len")).dropDuplicates(["item", "win"]))


def _known_places(docs: DataFrame, known: DataFrame, widths: list[int], names: list[str], text_col: str, slice_rows: int) -> DataFrame:
    """(*names, key, n_words, at, sid): a row a document, ``sid`` null, and a row for each place of a
    known shingle in it, ``names`` null."""
    n = F.size("_w_")
    texts = docs.select(*names, text_key(F.col(text_col)).alias("_key_"), words(F.col(text_col)).alias("_w_"))
    # Places count through all widths; -1 is the document itself and meets the empty shingle.
    placed = texts.withColumn("_p_", F.explode(F.sequence(F.lit(-1), len(widths) * n - 1)))
    per = F.greatest(n, F.lit(1))
    width = reduce(lambda other, i: F.when(F.expr("_p_") < (i + 1) * per, F.lit(widths[i])).otherwise(other), reversed(range(len(widths))), F.lit(0))
    own = F.col("_p_") < 0
    placed = placed.withColumns({"_width_": F.when(own, F.lit(0)).otherwise(width), "_at_": F.when(own, F.lit(0)).otherwise(F.col("_p_") % per)})
    placed = placed.filter(F.col("_at_") + F.col("_width_") <= n)
    part = F.slice("_w_", F.col("_at_") + 1, F.col("_width_"))
    placed = placed.withColumn("_h_", F.xxhash64(part))
    slices = 1 + known.count() // slice_rows
    found = []
    for i in range(slices):
        some = known.filter(F.pmod(F.xxhash64("sid"), F.lit(slices)) == i).select(F.xxhash64("part").alias("_h_"), F.col("part").alias("_part_"), F.col("sid").alias("_sid_"))
        empty = F.array().cast("array<string>")
        one = docs.sparkSession.range(1).select(F.xxhash64(empty).alias("_h_"), empty.alias("_part_"), F.lit(None).cast("binary").alias("_sid_"))
        rows = placed.join(F.broadcast(some.unionByName(one)), "_h_").filter(part == F.col("_part_"))
        found.append(rows if i == 0 else rows.filter("_p_ >= 0"))
    mine = [F.when(F.col("_sid_").isNull(), F.col(c)).alias(c) for c in names]
    return reduce(DataFrame.unionByName, found).select(*mine, F.col("_key_"), n.cast("long").alias("_n_"), F.col("_at_"), F.col("_sid_"))


def window_hits(places: DataFrame, windows: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, hits, items): for each different text (key, n, at, sid) with an occurrence of a window, the
    sorted word ranges [start, end) of all occurrences and the ids of their items. ``parts`` are the
    windows' shingles (win, len, off, sid)."""
    # Copies of a text are one row a place, counted; Spark adds them up before the shuffle.
    hits = materialize(places.groupBy("key", "n", "at", "sid").agg(F.count("*").alias("copies")), "shingle-places")
    counts = hits.groupBy("sid").agg(F.sum("copies").alias("rarity"))
    # Rarity order; a window with a shingle that stands nowhere goes.
    ranked = (parts.join(counts, "sid", "left").groupBy("win", "len")
              .agg(F.min(F.coalesce("rarity", F.lit(0))).alias("least"), F.min(F.struct("rarity", "sid", "off")).alias("p"), F.count("*").alias("shingles"))
              .filter("least > 0").select("win", "len", "shingles", "p.sid", "p.off"))
    start = F.col("at") - F.col("off")
    candidates = (hits.join(materialize(ranked, "prefixes"), "sid").filter((start >= 0) & (start + F.col("len") <= F.col("n")))
                  .select("key", start.alias("start"), "win", "len", "shingles"))
    needed = candidates.join(parts.select("win", "off", "sid"), "win").withColumn("at", F.col("start") + F.col("off"))
    occurring = (needed.join(hits.select("key", "at", "sid"), ["key", "at", "sid"]).groupBy("key", "start", "win", "len", "shingles").count()
                 .filter(F.col("count") == F.col("shingles")))
    occurring = materialize(occurring, "occurrences")
    spans = occurring.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("hits"))
    items = (occurring.select("key", "win").distinct().join(windows.select("win", "item"), "win")
             .groupBy("key").agg(F.collect_set("item").alias("items")))
    return spans.join(items, "key", "left").withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))


def covered(spans: Column) -> Column:
    """Positions in at least one of the sorted ranges."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["reach"], s["start"]))).alias("n"),
        F.greatest(a["reach"], s["end"]).alias("reach"))
    return F.coalesce(F.aggregate(spans, first, step, lambda a: a["n"]), F.lit(0))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, share: int = 20,
                  id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  keep: tuple[str, ...] = (), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(id_col, *keep, n_words, hits, items, n_hit, contaminated) of every row.

    ``hits`` holds the word ranges of occurring windows, ``items`` the ids of their items, both
    null where there are none; a text is contaminated if its hit words are at least one in
    ``share``. Null and empty texts have no words and are clean. Repeated rows get equal results.
    Items without words give no windows; an item without an id counts for hits and is not named.
    An empty benchmark finds nothing. Other columns are not read.
    """
    windows = materialize(item_windows(benchmark, window, item_id, item_text), "windows")
    width = F.least("len", F.lit(shingle))
    parts = (windows.dropDuplicates(["win"]).withColumn("width", width).withColumn("off", F.explode(_starts(F.col("len"), F.col("width"))))
             .withColumn("part", F.slice("words", F.col("off") + 1, F.col("width"))).withColumn("sid", word_id(F.col("part"))))
    parts = materialize(parts.select("win", "len", "off", "sid", "part", "width"), "window-shingles")
    widths = sorted(r["width"] for r in parts.select("width").distinct().collect()) or [shingle]  # 1 to shingle
    names = list(dict.fromkeys([id_col, *keep]))
    read = materialize(_known_places(docs, parts.select("sid", "part").dropDuplicates(["sid"]), widths, names, text_col, slice_rows), "known-places")
    places = read.filter("_sid_ IS NOT NULL").select(F.col("_key_").alias("key"), F.col("_n_").alias("n"), F.col("_at_").alias("at"), F.col("_sid_").alias("sid"))
    # Written, so that the join shuffles both sides for itself and Spark may split a hot text.
    found = materialize(window_hits(places, windows, parts), "window-hits").withColumnRenamed("key", "_key_")
    rows = read.filter("_sid_ IS NULL").select(*names, "_key_", F.col("_n_").alias("n_words")).join(found, "_key_", "left").drop("_key_")
    return (rows.withColumn("n_hit", covered(F.col("hits")).cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))
