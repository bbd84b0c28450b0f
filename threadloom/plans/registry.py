"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.functions import text as X
from threadloom.functions.prompts import first_candidate
from threadloom.functions.times import format_sent, parse_sent
from threadloom.operators import aggregates, checks, conversations, examples, gate, replies, scrub, splits
from threadloom.plans import prepare, surface
from threadloom.plans.fixture import CFG, ROLE_CFG, SPLIT, as_messages, messages, role_messages, table
from threadloom.schema import MESSAGE, create_message_table
from threadloom.sources.examples import read_examples, write_examples
from threadloom.sources.messages import append_messages, channels_of, flatten_raw, incremental_ingest, read_messages
from threadloom.sources import snapshots
from threadloom.sources.names import explode_names
from threadloom.storage import materialize, new_path
from threadloom.streaming import live, runs, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BUSY = timedelta(hours=30)
CHANNEL = 7
INGEST_TEST_LIMIT = 5
SEED = 17
WHOLE_RUN = 1 << 62  # bytes of a micro-batch that takes all that has landed
ID_WIDTH = 2_500  # of the fixture's ids, which are dense


def query(fn: Query) -> Query:
    """Register under the function's name, less a trailing ``_query``."""
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def utc(column: str):
    """Timestamp shown as UTC wall time."""
    return F.convert_timezone(None, F.lit("UTC"), F.col(column)).alias(column)


# Sources and sinks

@query
def scan_messages(spark, sf_dir):
    m = messages(spark, sf_dir)
    raw = m.select(
        F.col("messageid").alias("id"),
        F.struct(F.col("channelid").alias("id"), F.col("channelname").alias("name")).alias("channel"),
        F.struct(F.col("userid").alias("id"), F.col("username").alias("name")).alias("author"),
        format_sent(F.col("sent")).alias("created_at"), "content",
        F.when(F.col("replyid").isNotNull(), F.struct(F.col("replyid").alias("message_id"))).alias("reference"))
    flat = flatten_raw(raw)
    return flat.select(*[utc("sent") if c == "sent" else c for c in flat.columns])


def _halves(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.filter(F.col("sent") < F.lit(SPLIT)), m.filter(F.col("sent") >= F.lit(SPLIT))


@query
def incremental_ingest_query(spark, sf_dir):
    prior, _ = _halves(spark, sf_dir)
    # Landing holds everything; the mark decides what is new.
    return incremental_ingest(messages(spark, sf_dir), prior, INGEST_TEST_LIMIT).select(
        "messageid", "channelid", "sent")



@query
def append_roundtrip(spark, sf_dir):
    path = new_path(spark, "messages")
    prior, new = _halves(spark, sf_dir)
    append_messages(prior, path)
    append_messages(new, path)
    return spark.read.schema(prior.schema).parquet(path).select(*prior.columns)


@query
def rewrite_roundtrip(spark, sf_dir):
    # Stored once, then text and conversations rewritten in place.
    path = new_path(spark, "snapshots")
    m = messages(spark, sf_dir)
    snapshots.create_snapshots(m, path)
    snapshots.rewrite_content(spark, path, m.schema, CFG)
    snapshots.rewrite_conversations(spark, path, m.schema, CFG)
    return snapshots.read_snapshot(spark, path, m.schema)


@query
def message_table(spark, sf_dir):
    # A catalog table of the message schema, filled and read by name.
    name = "messages_" + uuid4().hex
    create_message_table(spark, name, new_path(spark, "message-table"))
    m = messages(spark, sf_dir, replies=False)
    at = F.to_timestamp_ltz(format_sent(F.col("sent")))
    m.withColumn("sent", at).select(*MESSAGE.fieldNames()).write.insertInto(name)
    return spark.table(name).select("messageid", "channelid", "userid", utc("sent"), "content")


@query
def channel_list(spark, sf_dir):
    # Allow-lists as arrays of id text, with a repeated and a malformed id.
    ids = F.array(*[F.col(c).cast("string") for c in ("c_custkey", "c_nationkey", "c_custkey")], F.col("c_mktsegment"))
    lists = table(spark, sf_dir, "customer").select("c_custkey", ids.alias("ids"))
    return channels_of(lists, "ids", "c_custkey")


@query
def names_dim(spark, sf_dir):
    return explode_names(table(spark, sf_dir, "events"), F.col("props"), "event_id")


@query
def examples_roundtrip(spark, sf_dir):
    path = new_path(spark, "examples")
    write_examples(training_examples(spark, sf_dir), path)
    return read_examples(spark, path)


@query
def json_roundtrip(spark, sf_dir):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select(
        "event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("json"))


@query
def parse_sent_query(spark, sf_dir):
    # Text in both layouts, with two offsets.
    whole = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = (F.when(F.col("event_id") % 3 == 0, F.concat(whole, F.lit("+00:00")))
            .when(F.col("event_id") % 3 == 1, F.concat(whole, F.date_format("ts", ".SSSSSS"), F.lit("+00:00")))
            .otherwise(F.concat(whole, F.lit("+0530"))))
    parsed = table(spark, sf_dir, "events").select("event_id", parse_sent(text).alias("sent"))
    return parsed.select("event_id", utc("sent"))


@query
def parse_sent_bad(spark, sf_dir):
    # Text without an offset, a bare year, an impossible day and a good one.
    whole = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = (F.when(F.col("event_id") % 4 == 0, whole).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy"))
            .when(F.col("event_id") % 4 == 2, F.concat(F.date_format("ts", "yyyy"), F.lit("-02-31 10:00:00+00:00")))
            .otherwise(F.concat(whole, F.lit("-03:00"))))
    parsed = table(spark, sf_dir, "events").select("event_id", parse_sent(text).alias("sent"))
    return parsed.select("event_id", utc("sent"))

@query
def format_sent_query(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", format_sent(F.col("ts")).alias("sent_text"),
        format_sent(F.date_trunc("second", "ts")).alias("whole_text"))


@query
def format_sent_zoned(spark, sf_dir):
    # The wall time is read as New York's, so the text is hours later.
    zoned = F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.col("ts"))
    at = F.to_timestamp_ltz(F.concat(zoned.cast("string"), F.lit("+00:00")))
    return table(spark, sf_dir, "events").select("event_id", format_sent(at).alias("sent_text"))



# Filters, order, limits

@query
def channel_filter(spark, sf_dir):
    return messages(spark, sf_dir, replies=False).filter(F.col("channelid") == CHANNEL).select(
        "messageid", "channelid", "userid", "sent", "content")


def building_channels(spark, sf_dir):
    """Allow-list: the customers of one market segment own the configured channels, newest first."""
    chosen = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return chosen.select((-F.col("c_custkey")).alias("ordinal"), F.col("c_custkey").alias("channelid"))


@query
def channel_semi_join(spark, sf_dir):
    m = messages(spark, sf_dir, replies=False)
    return conversations.in_channels(m, building_channels(spark, sf_dir)).select(
        "messageid", "channelid", "userid", "sent")


@query
def ordered_messages(spark, sf_dir):
    return messages(spark, sf_dir, replies=False).select("messageid", "channelid", "sent").orderBy(
        "sent", "messageid")


@query
def latest_n_per_channel(spark, sf_dir):
    newest = aggregates.latest_n_per_channel(
        messages(spark, sf_dir, replies=False), CFG.history, F.col("messageid"))
    return newest.select("channelid", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query
def first_candidate_query(spark, sf_dir):
    words = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", first_candidate(words).alias("candidate"))



# Joins and checks

@query
def reply_join(spark, sf_dir):
    return replies.reply_join(messages(spark, sf_dir))


@query
def unresolved_refs(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    # Member 3 and the channels of other segments have no name.
    known = customers.join(building_channels(spark, sf_dir).select(
        F.col("channelid").cast("string").alias("id")), "id", "left_semi").filter(~F.col("id").isin("1", "2", "3", "4"))
    members = known.unionByName(scrub.names_table(known, CFG).filter(F.col("id") != "3"))
    return checks.unresolved_refs(messages(spark, sf_dir), members, CFG)


# Aggregates

@query
def latest_per_channel(spark, sf_dir):
    return aggregates.latest_per_channel(messages(spark, sf_dir, replies=False))


@query
def max_conversation(spark, sf_dir):
    return conversations.max_conversation(assign_conversations(spark, sf_dir))


@query
def distinct_conversations(spark, sf_dir):
    return aggregates.distinct_conversations(assign_conversations(spark, sf_dir))


@query
def ingest_stats(spark, sf_dir):
    prior, _ = _halves(spark, sf_dir)
    return aggregates.ingest_stats(incremental_ingest(messages(spark, sf_dir), prior))


@query
def clean_stats(spark, sf_dir):
    return aggregates.clean_stats(messages(spark, sf_dir, replies=False), CFG)


@query
def conversation_stats(spark, sf_dir):
    return aggregates.conversation_stats(conversations.assign_conversations(messages(spark, sf_dir), CFG))


@query
def example_stats(spark, sf_dir):
    prepared = prepare.prepared_messages(messages(spark, sf_dir), CFG)
    return aggregates.example_stats(examples.training_examples(prepared, CFG), prepared)


# Text

def _text(spark, sf_dir, out, fn):
    return messages(spark, sf_dir, replies=False).select("messageid", fn(F.col("content")).alias(out))


@query
def strip_urls(spark, sf_dir):
    return _text(spark, sf_dir, "text", X.strip_urls)


@query
def strip_urls_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_urls(F.col("html")).alias("text"))


@query
def strip_emoji(spark, sf_dir):
    return _text(spark, sf_dir, "text", X.strip_emoji)


@query
def mention_ids(spark, sf_dir):
    return _text(spark, sf_dir, "ids", lambda c: F.array_join(X.mention_ids(c), ","))


@query
def replace_mentions(spark, sf_dir):
    return _text(spark, sf_dir, "text", lambda c: X.replace_mentions(c, X.names_map(CFG.names)))


@query
def collapse_ws(spark, sf_dir):
    return _text(spark, sf_dir, "text", X.collapse_spaces)


@query
def collapse_ws_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.collapse_spaces(F.col("text")).alias("text"))


@query
def clean_training(spark, sf_dir):
    return scrub.clean_messages(messages(spark, sf_dir, replies=False), CFG, training=True).select(
        "messageid", "content")


@query
def clean_inference(spark, sf_dir):
    return scrub.clean_messages(messages(spark, sf_dir, replies=False), CFG, training=False).select(
        "messageid", "content")


@query
def clean_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("messageid"), F.col("doc_id").alias("userid"), F.col("text").alias("content"))
    return scrub.clean_messages(rows, CFG, training=True).select(F.col("messageid").alias("doc_id"), "content")


@query
def format_messages(spark, sf_dir):
    cleaned = scrub.clean_messages(messages(spark, sf_dir, replies=False), CFG, training=False)
    return scrub.format_messages(cleaned, CFG, training=False)


def _customer_names(spark, sf_dir):
    """Names from a table: the customers', of which one is given twice and one has an odd id."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    odd = names.filter("id = '1'").select(F.lit("not-a-number").alias("id"), "name")
    return names.unionByName(names.filter("id = '2'")).unionByName(odd)


@query
def clean_training_joined(spark, sf_dir):
    rows = scrub.clean_messages(messages(spark, sf_dir, replies=False), CFG, True, names=_customer_names(spark, sf_dir))
    return rows.select("messageid", "content")


@query
def format_messages_joined(spark, sf_dir):
    names = _customer_names(spark, sf_dir)
    cleaned = scrub.clean_messages(messages(spark, sf_dir, replies=False), CFG, True, names=names)
    return scrub.format_messages(cleaned, CFG, True, names)


# Conversations

@query
def prev_message(spark, sf_dir):
    return conversations.prev_message(messages(spark, sf_dir, replies=False), CFG)


@query
def author_runs(spark, sf_dir):
    return conversations.author_runs(messages(spark, sf_dir, replies=False), CFG)


@query
def conversation_breaks(spark, sf_dir):
    return conversations.conversation_breaks(messages(spark, sf_dir), CFG)


@query
def conversation_heads(spark, sf_dir):
    return conversations.conversation_heads(messages(spark, sf_dir), CFG)


@query
def assign_conversations(spark, sf_dir):
    return conversations.assign_conversations(messages(spark, sf_dir), CFG).drop("channelid")


SPLIT_CFG = replace(CFG, max_group_rows=50)


@query
def assign_conversations_split(spark, sf_dir):
    # The plan for large groups: the limit is below most channels' rows.
    return conversations.assign_conversations(messages(spark, sf_dir), SPLIT_CFG).drop("channelid")


@query
def training_examples_split(spark, sf_dir):
    return prepare.prepare_examples(messages(spark, sf_dir), replace(CFG, max_group_rows=20))


@query
def trigger_gate_split(spark, sf_dir):
    triggers = examples.chat_triggers(messages(spark, sf_dir, replies=False), CFG)
    return gate.trigger_gate(triggers, BUSY, max_group_rows=3)


@query
def assign_conversations_listed(spark, sf_dir):
    return conversations.assign_conversations(
        messages(spark, sf_dir), CFG, building_channels(spark, sf_dir)).drop("channelid")


@query
def assign_conversations_incremental(spark, sf_dir):
    prior, new = _halves(spark, sf_dir)
    stored = materialize(prepare.with_conversations(prior, CFG), "stored")
    return conversations.assign_new(new, stored, CFG).drop("channelid")


@query
def conversation_position(spark, sf_dir):
    return conversations.conversation_position(
        prepare.with_conversations(messages(spark, sf_dir), CFG), CFG)


# Examples, prompts, splits

@query
def training_examples(spark, sf_dir):
    return prepare.prepare_examples(messages(spark, sf_dir), CFG)


@query
def sql_surface(spark, sf_dir):
    # Cleaned text and lines of all messages, prompts of all examples and contexts, asked for in SQL.
    m = messages(spark, sf_dir)
    surface.register_text(spark, CFG)
    surface.register_tables(spark, prepare.prepared_messages(m, CFG), m, CFG)
    m.createOrReplaceTempView("chat_messages")
    return spark.sql(f"""
        WITH cleaned AS (SELECT messageid, userid, chat_clean(content, userid) AS text, chat_clean_live(content, userid) AS live FROM chat_messages)
        SELECT c.messageid, text, live, chat_line(userid, text) AS line, chat_line_live(userid, live) AS live_line,
               chat_training_prompt(e.instruction, e.input, e.output) AS example, chat_prompt({surface.quoted(CFG.instruction_text)}, x.context) AS asked, x.context
        FROM cleaned c LEFT JOIN chat_examples(NULL, NULL) e ON e.messageid = c.messageid
        LEFT JOIN chat_contexts(NULL) x ON x.messageid = c.messageid""")


@query
def role_examples(spark, sf_dir):
    return examples.training_examples(role_messages(spark, sf_dir), ROLE_CFG)


@query
def chat_triggers(spark, sf_dir):
    return examples.chat_triggers(messages(spark, sf_dir, replies=False), CFG)


@query
def chat_context(spark, sf_dir):
    return examples.chat_context(messages(spark, sf_dir, replies=False), CFG)


@query
def render_training_prompt(spark, sf_dir):
    return examples.render_training(training_examples(spark, sf_dir)).drop("completion_start")


@query
def completion_span(spark, sf_dir):
    return examples.render_training(training_examples(spark, sf_dir)).select(
        "messageid", "completion_start",
        F.expr("substr(prompt, completion_start + 1)").alias("completion"))


@query
def render_inference_prompt(spark, sf_dir):
    return examples.render_inference(chat_context(spark, sf_dir), CFG)


EXAMPLE_ORDER = ["conversid", "sent", "messageid"]


def _folded(spark, sf_dir):
    made = prepare.prepare_examples(messages(spark, sf_dir), CFG, keep=("sent",))
    return splits.with_own_fold(made.select(*EXAMPLE_ORDER), EXAMPLE_ORDER)


@query
def kfold_split(spark, sf_dir):
    return splits.kfold_split(_folded(spark, sf_dir))


@query
def kfold_sizes(spark, sf_dir):
    return splits.kfold_sizes(_folded(spark, sf_dir))


@query
def random_split(spark, sf_dir):
    key = (F.col("messageid") * 7919 + SEED) % 1000003
    return splits.random_split(training_examples(spark, sf_dir), key)


# Streams

def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return as_messages(streams.read_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet"))


def _run(spark, stream, label):
    path = new_path(spark, label)
    streams.run_to_parquet(stream, path, new_path(spark, label + "-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


def _ingested(spark, parts, cut=False):
    """Lands each list of tables in turn, a run after each, and reads what was stored. With ``cut`` a
    run has about as many micro-batches as there are tables in its list."""
    landing, stored, mark = (new_path(spark, x) for x in ("landing", "stored", "mark"))
    schema = parts[0][0].schema
    for part in parts:
        for df in part:
            df.write.mode("append").parquet(landing)
        size = WHOLE_RUN
        if cut:
            landed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(landing)
            size = max(1, landed.agg(F.sum("length")).first()[0] // len(part))
        streams.ingest(streams.read_stream(spark, landing, schema, size), stored, mark, ID_WIDTH)
    return read_messages(spark, stored, schema=schema).select("messageid", "channelid", "userid", "sent", "content", "replyid")


@query
def stream_ingest(spark, sf_dir):
    # Two runs: the later half lands after the first run, together with a repeat of the earlier.
    prior, new = _halves(spark, sf_dir)
    return _ingested(spark, [[prior], [new.unionByName(prior.filter(F.col("sent") >= F.lit(SPLIT - timedelta(days=1))))]])


@query
def stream_ingest_backfill(spark, sf_dir):
    # One channel's newer half first; then, in several micro-batches, everyone's later half, their older
    # histories and repeats of both.
    prior, new = _halves(spark, sf_dir)
    one = F.col("channelid") == CHANNEL
    rest = [new.filter(~one), prior.filter(F.col("channelid") % 2 == 0), prior.filter(F.col("channelid") % 2 == 1),
            new.filter(one | (F.col("messageid") % 5 == 0)), prior.filter(F.col("messageid") % 3 == 0)]
    return _ingested(spark, [[new.filter(one)], rest], cut=True)


def _raw_lines(m):
    """Messages as the chat service hands them over, some lines broken off and some naming no message."""
    raw = F.struct(
        F.col("messageid").alias("id"), F.struct(F.col("channelid").alias("id"), F.col("channelname").alias("name")).alias("channel"),
        F.struct(F.col("userid").alias("id"), F.col("username").alias("name")).alias("author"),
        format_sent(F.col("sent")).alias("created_at"), "content",
        F.when(F.col("replyid").isNotNull(), F.struct(F.col("replyid").alias("message_id"))).alias("reference"))
    broken = F.concat(F.lit('{"id": '), F.col("messageid"), F.lit(', "channel'))
    unnamed = F.concat(F.lit('{"content":"'), F.col("messageid"), F.lit('"}'))
    return m.select(F.when(F.col("messageid") % 97 == 0, broken).when(F.col("messageid") % 89 == 0, unnamed).otherwise(F.to_json(raw)).alias("value"))


@query
def stream_ingest_json(spark, sf_dir):
    # Two runs; the second brings part of the first half again, its broken lines left out.
    prior, new = _halves(spark, sf_dir)
    again = prior.filter((F.col("sent") >= F.lit(SPLIT - timedelta(days=1))) & (F.col("messageid") % 97 != 0) & (F.col("messageid") % 89 != 0))
    landing, stored, unread, work = (new_path(spark, x) for x in ("landing", "stored", "unread", "work"))
    for part in (prior, new.unionByName(again)):
        _raw_lines(part).write.mode("append").text(landing)
        streams.ingest_json(streams.read_line_stream(spark, landing), stored, unread, work, ID_WIDTH)
    kept = read_messages(spark, stored)
    lost = streams.read_results(spark, unread, "line string")
    return (kept.select("messageid", "channelid", "userid", utc("sent"), "content", "replyid", F.lit(None).cast("string").alias("line"))
            .unionByName(lost, allowMissingColumns=True))


@query
def stream_assign(spark, sf_dir):
    # Three runs: the first half less some channels and rows; these late rows; the second half.
    prior, new = _halves(spark, sf_dir)
    late = F.col("messageid") % 11 == 0
    unseen = F.col("channelid") % 5 == 0
    landing, stored, mark, done = (new_path(spark, x) for x in ("landing", "stored", "mark", "assigned"))
    for part in (prior.filter(~late & ~unseen), prior.filter(late | unseen), new):
        part.write.mode("append").parquet(landing)
        runs.ingest_run(spark, landing, stored, mark, prior.schema, ID_WIDTH)
        runs.assign_run(spark, stored, done, CFG, prior.schema, width=ID_WIDTH)
    return read_messages(spark, done, schema=prior.schema).select("messageid", "conversid", "isFirstInConvers")


@query
def stream_triggers(spark, sf_dir):
    return _run(spark, streams.trigger_stream(_event_stream(spark, sf_dir), CFG), "triggers")


CONTEXT = "messageid long, channelid long, context string"


@query
def stream_context(spark, sf_dir):
    out = new_path(spark, "context")
    streams.context_run(_event_stream(spark, sf_dir), CFG, out, new_path(spark, "context-work"))
    return streams.read_results(spark, out, CONTEXT)


@query
def stream_context_unordered(spark, sf_dir):
    # Files out of time order, one a micro-batch, in one run.
    m = messages(spark, sf_dir, replies=False)
    landing, out = new_path(spark, "landing"), new_path(spark, "context")
    for first, last in ((21, 31), (11, 20), (1, 10)):
        m.filter(F.dayofmonth("sent").between(first, last)).coalesce(1).write.mode("append").parquet(landing)
    streams.context_run(streams.read_stream(spark, landing, m.schema, max_bytes=1), CFG, out, new_path(spark, "context-work"))
    return streams.read_results(spark, out, CONTEXT)


def _live(spark, sf_dir, busy):
    # In order of time, a week a micro-batch; stopped after each and started again.
    m = messages(spark, sf_dir, replies=False)
    landing, out, mark = (new_path(spark, x) for x in ("landing", "answers", "mark"))
    for day in range(1, 31, 7):
        m.filter(F.dayofmonth("sent").between(day, min(day + 6, 31))).write.mode("append").parquet(landing)
        answers = live.live_answers(streams.read_stream(spark, landing, m.schema, max_bytes=WHOLE_RUN), CFG, busy)
        streams.run_to_parquet(answers, out, mark)
    return spark.read.schema(answers.schema).parquet(out)


@query
def live_context(spark, sf_dir):
    return _live(spark, sf_dir, None).drop("sent")


@query
def live_gate(spark, sf_dir):
    return _live(spark, sf_dir, BUSY).drop("context")


@query
def stream_gate(spark, sf_dir):
    triggers = streams.trigger_stream(_event_stream(spark, sf_dir), CFG)
    out = new_path(spark, "gate")
    streams.gate_run(triggers, BUSY, out, new_path(spark, "gate-work"))
    schema = StructType([triggers.schema[c] for c in ("channelid", "messageid", "sent")])
    return streams.read_results(spark, out, schema)


@query
def trigger_gate(spark, sf_dir):
    return gate.trigger_gate(
        examples.chat_triggers(messages(spark, sf_dir, replies=False), CFG), BUSY)
