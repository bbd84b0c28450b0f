"""One complete run over newly landed messages.

Assignment over runs reads what is new and what it touches, not what is stored. Kept between runs, in
``work``:

* ``last``/n: each channel's newest assigned message, and the largest conversation id in it;
* ``spans``/n: for each channel and id range the newest message that run n stored there;
* ``result``/n: what run n assigned, written whole before any of it is stored;
* ``held``/n: messages of channels that are not listed yet.

A run that comes after the newest message of its channels needs no more than ``last``. Late messages
also need their channel's rows around them: folders whose span reaches beyond them are read, and of
all earlier ones just the span's newest message. Reply targets are read from the folders of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import ID_WIDTH, UNASSIGNED, ChatConfig
from threadloom.operators.conversations import assign_conversations, in_channels, max_conversation
from threadloom.sources.messages import append_by_id, children, id_range, id_ranges, in_ranges, not_stored, remove
from threadloom.storage import materialize
from threadloom.streaming.streams import _stage, drop_staged, ingest, read_stream, staged

NARROW = ["messageid", "channelid", "userid", "sent", "replyid", "conversid"]


def _at(prefix: str = "") -> Column:
    return F.struct(prefix + "sent", prefix + "messageid")


def ingest_run(spark: SparkSession, landing: str, table: str, checkpoint: str, schema, width: int = ID_WIDTH) -> None:
    """Take over what has landed since the last run."""
    ingest(read_stream(spark, landing, schema), table, checkpoint, width)


def _around_late(spark: SparkSession, late: DataFrame, assigned: str, work: str, schema, width: int) -> DataFrame:
    """Of the channels of ``late`` (channelid, _start): assigned rows from the start on, and the
    newest one before it."""
    spans = (spark.read.option("recursiveFileLookup", True).parquet(f"{work}/spans").join(late, "channelid")
             .withColumn("_end", _at("row.")))
    reach = spans.filter(F.col("_end") >= F.col("_start"))
    folders = sorted(r.ids for r in reach.select("ids").distinct().collect())
    rows = in_ranges(spark, assigned, schema, folders).select(*NARROW).join(late, "channelid")
    earlier = (spans.filter(F.col("_end") < F.col("_start")).select("row.*")
               .unionByName(rows.filter(_at() < F.col("_start")).select(*NARROW)))
    before = earlier.groupBy("channelid").agg(F.max_by(F.struct(*NARROW), _at()).alias("row")).select("row.*")
    return rows.filter(_at() >= F.col("_start")).select(*NARROW).unionByName(before)


def _touched(spark: SparkSession, new: DataFrame, last: DataFrame, assigned: str, work: str, schema, width: int) -> DataFrame:
    """Assigned rows that the assignment of ``new`` looks at."""
    starts = new.groupBy("channelid").agg(F.min(_at()).alias("_start"))
    ends = materialize(last.select("row.*").join(starts, "channelid"), "ends")
    seen = ends.filter(_at() < F.col("_start")).select(*NARROW)
    late = ends.filter(_at() >= F.col("_start")).select("channelid", "_start")
    if not late.isEmpty():
        seen = seen.unionByName(_around_late(spark, late, assigned, work, schema, width))
    targets = new.select("replyid").filter("replyid IS NOT NULL").distinct()
    found = in_ranges(spark, assigned, schema, id_ranges(targets, "replyid", width)).select(*NARROW)
    found = found.join(targets.withColumnRenamed("replyid", "messageid"), "messageid", "left_semi").select(*NARROW)
    return seen.unionByName(found).dropDuplicates(["messageid"])


def _assigned_rows(spark, rows: DataFrame, last: DataFrame | None, assigned: str, work: str, cfg: ChatConfig, schema, width: int) -> DataFrame:
    new = rows.select(*NARROW).withColumn("conversid", F.lit(UNASSIGNED).cast("long"))
    first_id = UNASSIGNED + 1
    if last is not None:
        first_id = max_conversation(last.withColumnRenamed("largest", "conversid")).first()["max_conversid"] + 1
        new = new.unionByName(_touched(spark, new, last, assigned, work, schema, width))
    found = assign_conversations(materialize(new, "touched"), cfg, None, first_id).drop("channelid")
    return rows.drop("conversid", "isFirstInConvers").join(found, "messageid").select(*schema.fieldNames())


def assign_run(spark: SparkSession, table: str, assigned: str, cfg: ChatConfig, schema,
               channels: DataFrame | None = None, work: str | None = None, width: int = ID_WIDTH) -> None:
    """Assign the messages of ``table`` that came since the last run and append them to ``assigned``.

    Late messages are taken like any others; what is assigned already keeps its conversation.
    Messages of channels that are not among ``channels`` wait for a run that lists them. A run that
    failed is made good by the next one: its result is written whole before any of it is stored.
    """
    work = work or f"{assigned}-work"
    unfinished = sorted(set(children(spark, f"{work}/result")) - set(children(spark, f"{work}/last")))
    if unfinished:
        # Nothing was staged since, so what is staged is what that run took.
        _finish(spark, assigned, work, unfinished[0], schema, width, again=True)
        drop_staged(spark, work, children(spark, f"{work}/staged"))
    _stage(read_stream(spark, table, schema, recursiveFileLookup=True), work)
    runs = children(spark, f"{work}/last")
    run = runs[-1] + 1 if runs else 0
    held = [f"{work}/held/{n}" for n in children(spark, f"{work}/held") if n < run][-1:]
    numbers, rows = staged(spark, work, schema, held)
    if not numbers and not held:
        return
    last = spark.read.parquet(f"{work}/last/{runs[-1]}") if runs else None
    if held or channels is not None:
        wait = rows.limit(0) if channels is None else rows.join(channels.select("channelid").distinct(), "channelid", "left_anti")
        wait.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{work}/held/{run}")
    listed = in_channels(rows, channels).select(*schema.fieldNames())
    new = materialize(not_stored(listed, assigned, width).select(*schema.fieldNames()), "unassigned")
    found = _assigned_rows(spark, new, last, assigned, work, cfg, schema, width)
    found.write.mode("overwrite").parquet(f"{work}/result/{run}")
    _finish(spark, assigned, work, run, schema, width)
    drop_staged(spark, work, numbers)


def _finish(spark: SparkSession, assigned: str, work: str, run: int, schema, width: int, again: bool = False) -> None:
    """Store a run's result and what later runs need of it. Only the result of a run that failed
    (``again``) can hold rows that are stored already; else the folders are not listed and read for it."""
    result = spark.read.schema(schema).parquet(f"{work}/result/{run}")
    rows = not_stored(result, assigned, width) if again else result
    append_by_id(rows.select(*schema.fieldNames()), assigned, width)
    row = F.struct(*NARROW)
    spans = result.groupBy(id_range("messageid", width).alias("ids"), "channelid").agg(F.max_by(row, _at()).alias("row"))
    spans.write.mode("overwrite").parquet(f"{work}/spans/{run}")
    ends = result.select("channelid", row.alias("row"), F.col("conversid").alias("largest"))
    if run:
        ends = ends.unionByName(spark.read.parquet(f"{work}/last/{run - 1}"))
    newest = ends.groupBy("channelid").agg(F.max_by("row", _at("row.")).alias("row"), F.max("largest").alias("largest"))
    newest.write.mode("overwrite").parquet(f"{work}/last/{run}")
    if run:
        remove(spark, f"{work}/last/{run - 2}")
        remove(spark, f"{work}/result/{run - 1}")
        remove(spark, f"{work}/held/{run - 1}")
