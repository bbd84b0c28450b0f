"""A stored message table that can be rewritten, a bucket at a time.

Rows lie in buckets of channels under ``path``/data/<version>/bucket=<b>. A snapshot, one row a
bucket under ``path``/snapshots/<version>, says in which version each bucket was written last. A
rewrite writes only the buckets that change and then its snapshot, whole. Readers take the newest
complete snapshot, so they see all of a rewrite or nothing of it, and one that began earlier still
finds its files; ``expire`` removes what only older snapshots name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.operators.conversations import assign_conversations, is_assigned, max_conversation
from threadloom.operators.scrub import clean_messages
from threadloom.sources.messages import BUCKETS, _names, children, remove
from threadloom.storage import materialize

SNAPSHOT = "bucket int, version int"


def bucket_of(channel: str = "channelid"):
    return F.pmod(F.xxhash64(channel), F.lit(BUCKETS)).cast("int")


def _snapshot(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """(version, {bucket: version that holds it}); at most BUCKETS entries."""
    versions = children(spark, f"{path}/snapshots")
    if not versions:
        return -1, {}
    at = versions[-1] if version is None else version
    return at, {r.bucket: r.version for r in spark.read.schema(SNAPSHOT).parquet(f"{path}/snapshots/{at}").collect()}


def _read(spark: SparkSession, path: str, schema, held: dict[int, int]) -> DataFrame:
    paths = [f"{path}/data/{v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The table as of a version, by default the newest."""
    return _read(spark, path, schema, _snapshot(spark, path, version)[1]).select(*schema.fieldNames())


def _put(rows: DataFrame, path: str, at: int, held: dict[int, int]) -> None:
    """Write ``rows``, which are whole buckets, as the next version."""
    spark, new = rows.sparkSession, at + 1
    if new in children(spark, f"{path}/data"):
        remove(spark, f"{path}/data/{new}")  # left by a rewrite that failed
    (rows.withColumn("bucket", bucket_of()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "channelid", "sent")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{new}"))
    written = {int(n.split("=")[1]): new for n in _names(spark, f"{path}/data/{new}") if n.startswith("bucket=")}
    entries = list({**held, **written}.items())
    spark.createDataFrame(entries, SNAPSHOT).coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshots/{new}")


def create_snapshots(messages: DataFrame, path: str) -> None:
    """The first version of a table."""
    if children(messages.sparkSession, f"{path}/snapshots"):
        raise ValueError(f"there is a table at {path}")
    _put(messages, path, -1, {})


def rewrite(spark: SparkSession, path: str, schema, changes: DataFrame) -> list[int]:
    """Store new values: ``changes`` has channelid, messageid and the columns to replace, for messages
    of the table. Gives the buckets written; with none, there is no new version."""
    at, held = _snapshot(spark, path)
    changes = materialize(changes, "changes")
    buckets = sorted(r.b for r in changes.select(bucket_of().alias("b")).distinct().collect())
    if not buckets:
        return []
    names = [c for c in changes.columns if c not in ("channelid", "messageid")]
    new = changes.select("messageid", F.struct(*names).alias("_new"))
    rows = _read(spark, path, schema, {b: held[b] for b in buckets}).select(*schema.fieldNames()).join(new, "messageid", "left")
    replaced = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in names}
    _put(rows.withColumns(replaced).select(*schema.fieldNames()), path, at, held)
    return buckets


def rewrite_content(spark: SparkSession, path: str, schema, cfg: ChatConfig, names: DataFrame | None = None) -> list[int]:
    """Replace stored text by cleaned text, where that differs."""
    rows = read_snapshot(spark, path, schema)
    cleaned = clean_messages(rows, cfg, True, "_clean", names)
    changed = cleaned.filter(~F.col("_clean").eqNullSafe(F.col("content")))
    return rewrite(spark, path, schema, changed.select("channelid", "messageid", F.col("_clean").alias("content")))


def rewrite_conversations(spark: SparkSession, path: str, schema, cfg: ChatConfig, channels: DataFrame | None = None) -> list[int]:
    """Give the stored messages that have no conversation one. Channels without such messages are not
    read beyond their largest conversation id."""
    rows = read_snapshot(spark, path, schema)
    first_id = max_conversation(rows).first()["max_conversid"] + 1
    waiting = materialize(rows.filter(~is_assigned()).select(bucket_of().alias("b")).distinct(), "waiting")
    _, held = _snapshot(spark, path)
    buckets = {r.b for r in waiting.collect()}
    beside = _read(spark, path, schema, {b: v for b, v in held.items() if b in buckets}).select(*schema.fieldNames())
    return rewrite(spark, path, schema, assign_conversations(beside, cfg, channels, first_id))


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` snapshots, and the buckets that no other one names."""
    versions = children(spark, f"{path}/snapshots")
    kept = versions[-keep:]
    named = {(b, v) for at in kept for b, v in _snapshot(spark, path, at)[1].items()}
    for at in versions[:-keep]:
        for b, v in _snapshot(spark, path, at)[1].items():
            if (b, v) not in named:
                remove(spark, f"{path}/data/{v}/bucket={b}")
        remove(spark, f"{path}/snapshots/{at}")
