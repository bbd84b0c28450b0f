"""A corpus pipeline of five of the operators in threadloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. ``run`` writes each
stage's result to the shared folder and hands the written table to the next.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import table
from threadloom.llm.decontam import contamination
from threadloom.llm.pii import find_spans, redacted
from threadloom.llm.quality import score_quality
from threadloom.llm.queries import piece_model, token_digests
from threadloom.llm.sentencepieces import encode_decode
from threadloom.llm.simhash import near_duplicates
from threadloom.storage import materialize

_KEY, _SPANS = "_pipeline_key_", "_pipeline_spans_"
BROADCAST_ENTRIES = 200_000  # keys of 16 or 32 bytes and spans of about as many


def _digest(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _keyed(docs: DataFrame) -> DataFrame:
    """With a digest of the text, null counting as empty. Decisions that follow from the text alone
    are joined by it: it is the same in every read of a table, however its files are cut, and no
    copy of the table is needed."""
    return docs.withColumn(_KEY, F.unhex(_digest(F.col("text"))))


def _decided(rows: DataFrame, spans: str | None = None) -> DataFrame:
    """Decisions by key, written; sent to every task if their keys and spans are few, else joined by
    shuffle."""
    rows = materialize(rows, "decisions")
    entries = rows.agg(F.sum(F.lit(1) + (F.size(spans) if spans else F.lit(0)))).first()[0] or 0
    return F.broadcast(rows) if entries <= BROADCAST_ENTRIES else rows


def _on_any_columns(stage):
    """The stage on a table that may have columns of the names it adds; these come back unchanged."""
    @wraps(stage)
    def run_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        taken = {c: f"{c}kept_" for c in docs.columns if c.startswith((_KEY, _SPANS))}
        found = stage(spark, docs.withColumnsRenamed(taken), sf_dir)
        return found.withColumnsRenamed({v: k for k, v in taken.items()})

    return run_stage


@_on_any_columns
def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = _keyed(docs)
    found = score_quality(docs, table(spark, sf_dir, "labels"), keep=(_KEY,))
    return docs.join(_decided(found.filter("predicted = 0").select(_KEY).distinct()), _KEY, "left_anti").drop(_KEY)


@_on_any_columns
def near_duplicate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; without ids, one row."""
    # By id and text; the digest of the text has a fixed length, so no two pairs read the same.
    known = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit(""))
    docs = docs.withColumn(_KEY, F.unhex(F.sha2(F.concat(_digest(F.col("text")), known), 256)))
    found = materialize(near_duplicates(docs, keep=(_KEY,)), "near-duplicates")
    rows = found.groupBy("component", "doc_id", _KEY).agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _KEY, "n")).alias("first")
    stay = materialize(rows.groupBy("component").agg(first).select(f"first.{_KEY}", "first.n"), "staying")
    rest = docs.join(_decided(found.select(_KEY).join(stay, _KEY, "left_anti").distinct()), _KEY, "left_anti")
    # Rows that stay and have their id and text in common: one of them.
    repeated = stay.filter("n > 1").select(_KEY)
    if not repeated.isEmpty():
        repeated = _decided(repeated)
        rest = (rest.join(repeated, _KEY, "left_anti")
                .unionByName(rest.join(repeated, _KEY, "left_semi").dropDuplicates([_KEY])))
    return rest.drop(_KEY)


@_on_any_columns
def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    docs = _keyed(docs)
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=(_KEY,))
    return docs.join(_decided(found.filter("contaminated").select(_KEY).distinct()), _KEY, "left_anti").drop(_KEY)


@_on_any_columns
def personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind; n_chars follows the text."""
    names = docs.columns
    docs = _keyed(docs)
    found = (find_spans(docs, keep=(_KEY,)).filter(F.size("spans") > 0)
             .select(_KEY, F.col("spans").alias(_SPANS)).dropDuplicates([_KEY]))
    text = F.when(F.col(_SPANS).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(_SPANS)))
    rows = docs.join(_decided(found, _SPANS), _KEY, "left").withColumn("text", text)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col(_SPANS).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return rows.select(*names)


def sentencepiece(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left and the text they decode to, as digests."""
    return token_digests(encode_decode(docs, piece_model()))


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("decontamination", decontamination),
          ("personal_data", personal_data), ("sentencepiece", sentencepiece)]
ORACLE_SQL = None  # SQL has neither the classifier nor the fingerprints' hash


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
