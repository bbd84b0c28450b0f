"""Reading, ingesting and storing messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from threadloom.config import ID_WIDTH, MAX_GROUP_ROWS, UNASSIGNED
from threadloom.functions.times import parse_sent
from threadloom.operators.ordered import ordered
from threadloom.operators.skew import hot_join
from threadloom.schema import MESSAGE, RAW_MESSAGE, empty_messages


BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _names(spark: SparkSession, path: str) -> list[str]:
    if not _exists(spark, path):
        return []
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    return [f.getPath().getName() for f in found]


def children(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete tables written as ``path``/number; none if there is no folder."""
    return sorted(int(n) for n in _names(spark, path) if n.isdigit() and _exists(spark, f"{path}/{n}/_SUCCESS"))


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def in_ranges(spark: SparkSession, path: str, schema, ranges: list[int]) -> DataFrame:
    """Rows of a table written by :func:`append_by_id` whose ids fall in these ranges; no other folder
    is read or listed."""
    there = set(_names(spark, path))
    paths = [f"{path}/ids={r}" for r in ranges if f"ids={r}" in there]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def id_range(ids: str, width: int = ID_WIDTH):
    return F.expr(f"{ids} div {width}L")


def id_ranges(rows: DataFrame, ids: str = "messageid", width: int = ID_WIDTH) -> list[int]:
    """The ranges the ids fall in: one value for ``width`` ids at most, so few."""
    found = rows.select(id_range(ids, width).alias("r")).filter("r IS NOT NULL").distinct().collect()
    return sorted(r.r for r in found)


def not_stored(rows: DataFrame, path: str, width: int = ID_WIDTH) -> DataFrame:
    """Each message once, less those whose id is in the table at ``path``, of which only the ids in
    the ranges of ``rows`` are read."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(["messageid"])
    if not _names(spark, path):
        return rows
    key = StructType([rows.schema["messageid"]])
    return rows.join(in_ranges(spark, path, key, id_ranges(rows, width=width)), "messageid", "left_anti")


def append_by_id(rows: DataFrame, path: str, width: int = ID_WIDTH) -> None:
    """Append, one folder a range of ids; a range holds ``width`` rows at most, if ids are unique."""
    (rows.withColumn("ids", id_range("messageid", width)).hint("rebalance", "ids")
     .write.mode("append").partitionBy("ids").parquet(path))


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", schema=MESSAGE) -> DataFrame:
    """Stored messages; an absent folder is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema) if schema is not MESSAGE else empty_messages(spark)
    return spark.read.schema(schema).format(fmt).load(path).select(*schema.fieldNames())


def parse_raw(lines: DataFrame) -> DataFrame:
    """Text lines (value) as raw messages, with ``_unread``: the line, if it is no JSON of this kind or
    names no message. Blank lines go. Works on streams too."""
    schema = StructType([*RAW_MESSAGE.fields, StructField("_broken", StringType())])
    raw = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.filter(F.trim("value") != "").select("value", raw.alias("raw"))
    bad = F.col("raw").isNull() | F.col("raw._broken").isNotNull() | F.col("raw.id").isNull()
    return rows.select("raw.*", F.when(bad, F.col("value")).alias("_unread")).drop("_broken")


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_raw(spark.read.text(path))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON Lines as handed over by the chat service, flattened; see ``unreadable_lines``
    for those left out."""
    return flatten_raw(_raw_lines(spark, path).filter(F.col("_unread").isNull()))


def unreadable_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, line) of landed lines that are no message, to be looked into."""
    return _raw_lines(spark, path).filter(F.col("_unread").isNotNull()).select("id", F.col("_unread").alias("line"))


def flatten_raw(raw: DataFrame) -> DataFrame:
    """Flat message rows, not yet assigned to a conversation. No reference gives a null reply."""
    return raw.select(
        F.col("id").alias("messageid"), F.col("channel.id").alias("channelid"),
        F.col("channel.name").alias("channelname"), F.col("author.id").alias("userid"),
        F.col("author.name").alias("username"), parse_sent(F.col("created_at")).alias("sent"),
        "content", F.col("reference.message_id").alias("replyid"),
        F.lit(UNASSIGNED).cast("long").alias("conversid"), F.lit(True).alias("isFirstInConvers"))


def high_water(stored: DataFrame) -> DataFrame:
    """(channelid, mark): the newest stored message per channel."""
    return stored.groupBy("channelid").agg(F.max(F.struct("sent", "messageid")).alias("mark"))


def newer_than(landing: DataFrame, marks: DataFrame) -> DataFrame:
    """Landed messages strictly newer than their channel's mark; all of them without a mark."""
    mark = marks.select("channelid", F.col("mark.sent").alias("_sent"), F.col("mark.messageid").alias("_id"))
    newer = F.col("_id").isNull() | (F.struct("sent", "messageid") > F.struct("_sent", "_id"))
    return hot_join(landing, mark, "channelid", MAX_GROUP_ROWS, "left").filter(newer).drop("_sent", "_id")


def incremental_ingest(landing: DataFrame, stored: DataFrame, limit: int | None = None,
                       max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """What one run fetches: per channel the messages newer than the stored ones, of these the
    oldest ``limit`` if one is given. The cut is by position in range chunks, so a large channel
    stays spread over tasks at any limit."""
    fresh = newer_than(landing, high_water(stored))
    if limit is None:
        return fresh
    placed = ordered(fresh, ["channelid"], ["sent", "messageid"], max_group_rows).with_position("_n").plain()
    return placed.filter(F.col("_n") < limit).drop("_n")


def append_messages(messages: DataFrame, path: str) -> None:
    """Append to the message table, one folder per bucket of channels, sorted by channel.

    Rebalancing gathers a bucket's rows before the write and splits a large bucket over several
    files; the commit covers all at once. The number of folders does not grow with the channels.
    """
    bucketed = messages.withColumn("bucket", F.pmod(F.xxhash64("channelid"), F.lit(BUCKETS)).cast("int"))
    (bucketed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "channelid", "sent")
     .write.mode("append").partitionBy("bucket").parquet(path))


def channel_list(spark: SparkSession, ids: list[str | int]) -> DataFrame:
    """(ordinal, channelid) of configured channels in their order."""
    return spark.createDataFrame(
        [(n, int(c)) for n, c in enumerate(ids)], "ordinal int, channelid long")


def channels_of(table: DataFrame, ids: str, *keep: str) -> DataFrame:
    """The same from an array column of id text, with the columns to keep; a bad id is null."""
    return (table.select(*keep, F.posexplode(ids).alias("ordinal", "id"))
            .select(*keep, "ordinal", F.expr("try_cast(id AS bigint)").alias("channelid")))
