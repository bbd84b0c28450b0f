"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words, a block a run of words, and they join if the block holds at least the
template's share of its words. Words are ordered by how often the corpus has them, rarest first;
a match must share one of a template's first n - need + 1 words, so only blocks with such a word
become candidates. Then a block of too few template words goes (length), as does one whose words
after the shared one are too few (position), and the overlap of the rest is counted. Blocks
overlap, so that everything up to a template's length lies within one; words that no template has
can't count and are left out from the start.

Templates are a fixed list. The short phrases among them (share 1) are verified as words that
stand consecutively, each place being counted in the one block that owns its start.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import LOWER, UPPER, WORD, words
from threadloom.storage import materialize


@dataclass(frozen=True)
class Template:
    """``phrase``: its words must stand consecutively. Otherwise ``share`` of them in one block."""

    label: str
    text: str
    phrase: bool = False
    share: float = 0.8

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(UPPER, LOWER)))

    @property
    def need(self) -> int:
        """How many of its different words a block must hold."""
        n = len(set(self.words))
        return n if self.phrase else math.ceil(self.share * n - 1e-9)


# The phrases and labels of the contract.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
# Common notices, in the wording of the public licenses they belong to.
NOTICES = (
    Template("all-rights-reserved", "All rights reserved", share=1.0),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", share=1.0),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", share=1.0),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files, to deal in the Software without restriction"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance "
                       "with the License. You may obtain a copy of the License at"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                    "General Public License as published by the Free Software Foundation"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                    "MPL was not distributed with this file, You can obtain one at"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_hits(docs: DataFrame, templates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id_col, n_words, hits): of every row the words that any template has, with places.

    Written once: row numbers must not change, and the text is read no more."""
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = docs.select(F.col(id_col).alias(id_col), words(F.col(text_col)).alias("w"))
    hits = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda h: h["w"].isin(vocabulary))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), id_col, F.size("w").cast("long").alias("n_words"),
                                   hits.alias("hits")), "license-words")


INDEX = "tid int, w string, off int, rank int, prefix boolean"


def _index(templates, counts: dict[str, int]) -> list[tuple]:
    """(template, word, offset, rank, prefix) of each word of the templates that can be met; rank 0 is
    the rarest word. Offsets matter for phrases alone."""
    found = []
    for tid, t in enumerate(templates):
        ordered = sorted(set(t.words), key=lambda w: (counts.get(w, 0), w))
        n, need = len(ordered), t.need
        if sum(1 for w in ordered if counts.get(w)) < need:
            continue  # no block can hold enough of it
        rank = {w: i for i, w in enumerate(ordered)}
        placed = list(enumerate(t.words)) if t.phrase else [(0, w) for w in ordered]
        found += [(tid, w, off, rank[w], rank[w] <= n - need) for off, w in placed]
    return found


def template_matches(rows: DataFrame, templates) -> DataFrame:
    """(row, label, phrase, start, overlap): a row for each place of a phrase and each block
    that meets a template's share.

    The corpus counts of the templates' own words (as many as the fixed list has) come to the driver.
    The words of rows with a prefix word are exploded once and joined with the templates' index, so
    the work grows with a text's length and the templates that share its words, however many there are."""
    spark = rows.sparkSession
    counted = rows.select(F.explode("hits").alias("h")).groupBy("h.w").count().collect()
    index = _index(templates, {r["w"]: r["count"] for r in counted})
    prefixes = sorted({w for _, w, _, _, prefix in index if prefix})
    known = F.broadcast(spark.createDataFrame(index, INDEX))
    facts = F.broadcast(spark.createDataFrame(
        [(i, t.label, t.phrase, len(t.words), len(set(t.words)), t.need) for i, t in enumerate(templates)],
        "tid int, label string, phrase boolean, stride int, n int, need int"))
    near = rows.filter(F.exists("hits", lambda h: h["w"].isin(prefixes))).select("row", F.explode("hits").alias("h"))
    met = near.select("row", "h.w", "h.p").join(known, "w").join(facts, "tid")
    # Phrases: all words at their offsets from one start.
    starts = (met.filter("phrase").groupBy("row", "label", "stride", (F.col("p") - F.col("off")).alias("start"), "tid")
              .agg(F.count("*").alias("found"), F.max("prefix").alias("able")).filter("able AND found = stride"))
    places = starts.select("row", "label", F.lit(True).alias("phrase"), "start", F.lit(1.0).alias("overlap"))
    # Other templates: candidates are blocks with a prefix word; a word lies in two blocks.
    block = F.floor(F.col("p") / F.col("stride")).cast("int")
    inside = met.filter("NOT phrase").withColumn("block", F.explode(F.array(block, block - 1))).filter("block >= 0")
    candidates = inside.filter("prefix").select("row", "tid", "block").distinct()
    # In rarity order, after the first shared word no more than n - first can be shared.
    blocks = (inside.join(candidates, ["row", "tid", "block"], "left_semi").groupBy("row", "tid", "label", "block", "n", "need")
              .agg(F.count("*").alias("size"), F.min("rank").alias("first"), F.size(F.collect_set("rank")).alias("own"))
              .filter("size >= need AND n - first >= need AND own >= need"))
    shared = blocks.select("row", "label", F.lit(False).alias("phrase"), F.lit(None).cast("int").alias("start"), (F.col("own") / F.col("n")).alias("overlap"))
    return places.unionByName(shared)


def scan_licenses(docs: DataFrame, templates=(*PHRASES, *NOTICES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``n_base`` counts all places of phrases, ``first_word`` and ``last_word`` are their smallest and
    largest start (null without any), ``base_labels`` the labels of phrases, ``labels`` those of all
    templates met, both sorted arrays; ``score`` is the largest share of a template met, else 0.
    Null and empty texts have no words. Repeated rows and ids each get their row. Other columns are
    not read.
    """
    rows = template_hits(docs, templates, id_col, text_col)
    found = template_matches(rows, templates).groupBy("row").agg(
        F.count("start").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.max("overlap").alias("score"))
    none = F.expr("cast(array() as array<string>)")
    return (rows.drop("hits").join(found, "row", "left")
            .select(id_col, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                    F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
