"""Streaming versions of ingest, trigger detection, busy gate and rolling context.

All run with ``availableNow``: a run takes what has landed since the last one and stops, the
checkpoint being the mark. ``max_bytes`` only sizes micro-batches; no result depends on it or on
the order of files.

Gate and context work on a run as a whole. Micro-batches are staged first; then the run's rows and
a small table of what earlier runs left behind per channel go through the batch operators. So
inside a run rows are in time order whatever file they came in. Across runs this rule holds: a run
answers the triggers that landed in it, and sees the rows of earlier runs only as far as they are
among the newest of their channel; a row that lands in a later run than a trigger is not seen by
that trigger, and a trigger older than the last one answered finds the channel busy. Landing must
not repeat messages here; the table that ``ingest`` fills does not.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import ID_WIDTH, ChatConfig
from threadloom.operators.examples import chat_context, chat_triggers
from threadloom.operators.gate import trigger_gate
from threadloom.operators.ordered import first_per_group
from threadloom.schema import MESSAGE
from threadloom.sources.messages import append_by_id, children, flatten_raw, not_stored, parse_raw, remove

Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def read_stream(spark: SparkSession, path: str, schema=MESSAGE, max_bytes: int = 512 << 20, **options) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes)
            .options(**options).parquet(path))


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write everything that has landed, then stop."""
    (stream.writeStream.format("parquet").outputMode("append")
     .option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _stage(stream: DataFrame, work: str, split: Callable[[DataFrame, int], DataFrame] = lambda batch, number: batch) -> None:
    """Write what has landed to ``work``/staged, a folder a micro-batch. A batch that is run again
    after a failure holds the same files and takes the place of its first try."""
    def stage(batch: DataFrame, number: int) -> None:
        split(batch, number).write.mode("overwrite").parquet(f"{work}/staged/{number}")

    _run_batches(stream, f"{work}/checkpoint", stage)


def staged(spark: SparkSession, work: str, schema, extra: list[str] | None = None) -> tuple[list[int], DataFrame | None]:
    """(numbers, rows) of what is staged and not yet dropped, with further tables of the same schema."""
    numbers = children(spark, f"{work}/staged")
    paths = [f"{work}/staged/{n}" for n in numbers] + (extra or [])
    return numbers, spark.read.schema(schema).parquet(*paths) if paths else None


def drop_staged(spark: SparkSession, work: str, numbers: list[int]) -> None:
    for n in numbers:
        remove(spark, f"{work}/staged/{n}")


def _store(spark: SparkSession, table: str, work: str, schema, width: int) -> None:
    numbers, rows = staged(spark, work, schema)
    if rows is None:
        return
    append_by_id(not_stored(rows, table, width), table, width)
    drop_staged(spark, work, numbers)


def ingest(stream: DataFrame, table: str, work: str, width: int = ID_WIDTH) -> None:
    """Append to ``table`` what has landed and is not there yet, each message once.

    A message is new if its id is not stored, however old it is and whatever its channel; nothing
    is held against a watermark. The run's micro-batches are staged and joined once, with the stored
    ids of the id ranges they fall in, so a run costs what has landed and not what is stored. A run
    that failed is made good by the next one, which finds stored what was stored.
    """
    _stage(stream, work)
    _store(stream.sparkSession, table, work, stream.schema, width)


def read_line_stream(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Text lines as they land. Files of this kind are cut by the service, so they count by number."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def ingest_json(lines: DataFrame, table: str, unread: str, work: str, width: int = ID_WIDTH) -> None:
    """``ingest`` from JSON Lines as the chat service hands them over. Lines that are no message are
    written to ``unread``, a folder a micro-batch, so that a repeated batch leaves them there once."""
    def split(batch: DataFrame, number: int) -> DataFrame:
        parsed = parse_raw(batch)
        lost = parsed.filter(F.col("_unread").isNotNull()).select(F.col("_unread").alias("line"))
        lost.write.mode("overwrite").parquet(f"{unread}/{number}")
        return flatten_raw(parsed.filter(F.col("_unread").isNull()))

    _stage(lines, work, split)
    _store(lines.sparkSession, table, work, MESSAGE, width)


def trigger_stream(stream: DataFrame, cfg: ChatConfig) -> DataFrame:
    return chat_triggers(stream, cfg)


def _run_step(stream: DataFrame, out: str, work: str, step: Step) -> None:
    """Stage what has landed, then let ``step`` turn the run's rows and the carried table into
    results and the next carried table. A run that failed is made good by the next one."""
    spark, schema = stream.sparkSession, stream.schema
    _stage(stream, work)
    done = max(children(spark, f"{work}/carried"), default=-1)
    drop_staged(spark, work, [n for n in children(spark, f"{work}/staged") if n <= done])
    new, rows = staged(spark, work, schema)
    if not new:
        return
    carried = spark.read.parquet(f"{work}/carried/{done}") if done >= 0 else None
    found, left = step(rows, carried)
    found.write.mode("overwrite").parquet(f"{out}/{max(new)}")
    left.write.mode("overwrite").parquet(f"{work}/carried/{max(new)}")
    drop_staged(spark, work, new)


def read_results(spark: SparkSession, out: str, schema) -> DataFrame:
    """Results of all runs."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def gate_run(stream: DataFrame, busy: timedelta, out: str, work: str) -> None:
    """Write the answered ones of the landed triggers; carried is the last answered per channel."""
    columns = ["channelid", "messageid", "sent"]
    at = F.struct("sent", "messageid")

    def step(rows: DataFrame, last: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        points = rows.select(*columns)
        if last is not None:
            marks = last.select("channelid", F.struct("sent", "messageid").alias("_mark"))
            later = points.join(marks, "channelid", "left").filter(F.col("_mark").isNull() | (at > F.col("_mark")))
            points = later.select(*columns).unionByName(last)
        kept = trigger_gate(points, busy)
        answered = kept if last is None else kept.join(last.select("messageid"), "messageid", "left_anti").select(*columns)
        newest = kept.groupBy("channelid").agg(F.max_by(F.struct(*columns), at).alias("r")).select("r.*")
        return answered, newest

    _run_step(stream, out, work, step)


def context_run(stream: DataFrame, cfg: ChatConfig, out: str, work: str, names: DataFrame | None = None) -> None:
    """Write (messageid, channelid, context) of the landed triggers; carried are the newest
    messages of each channel, as many as a trigger looks back at."""
    columns = ["messageid", "channelid", "userid", "sent", "content"]

    def step(rows: DataFrame, last: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = rows.select(*columns, F.lit(True).alias("_asked"))
        if last is not None:
            rows = rows.unionByName(last.withColumn("_asked", F.lit(False)))
        newest = first_per_group(rows, ["channelid"], [F.col("sent").desc(), F.col("messageid").desc()],
                                 cfg.history - 1, F.col("messageid"))
        return chat_context(rows, cfg, names, asked=F.col("_asked")), newest.select(*columns)

    _run_step(stream, out, work, step)
