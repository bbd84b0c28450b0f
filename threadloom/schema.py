"""Table contracts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("messageid", T.LongType(), False),
    T.StructField("channelid", T.LongType()),
    T.StructField("channelname", T.StringType()),
    T.StructField("userid", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("sent", T.TimestampType()),
    T.StructField("content", T.StringType(), False),
    T.StructField("replyid", T.LongType()),
    T.StructField("conversid", T.LongType()),
    T.StructField("isFirstInConvers", T.BooleanType()),
])

EXAMPLE = T.StructType([
    T.StructField("conversid", T.LongType()),
    T.StructField("messageid", T.LongType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])

# A message as the chat service hands it over, before flattening.
RAW_MESSAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("channel", T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])),
    T.StructField("author", T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])),
    T.StructField("created_at", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("reference", T.StructType([T.StructField("message_id", T.LongType())])),
])


def create_message_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the message table in the catalog unless it is there."""
    where = f" LOCATION '{location}'" if location else ""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MESSAGE)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{where}")


def empty_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MESSAGE)
