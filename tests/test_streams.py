"""Streams over several runs equal their batch twins."""

from dataclasses import replace
from datetime import timedelta

import pytest
from model import HOUR, assign
from test_conversations import random_lists

from threadloom.operators import examples, gate
from threadloom.plans import registry
from threadloom.plans.fixture import CFG, SPLIT, messages
from threadloom.sources.messages import read_messages
from threadloom.streaming import runs, streams

SF = "/root/testdata/sf0.001"
BUSY = timedelta(hours=30)


@pytest.fixture(scope="module")
def halves(spark):
    m = messages(spark, SF, replies=False).persist()
    return m, m.filter(m.sent < SPLIT), m.filter(m.sent >= SPLIT)


def two_runs(spark, halves, make, tmp_path):
    """Land, run, land more, run again."""
    _, prior, new = halves
    landing, out, mark = (str(tmp_path / x) for x in ("landing", "out", "mark"))
    for part in (prior, new):
        part.write.mode("append").parquet(landing)
        stream = make(streams.read_stream(spark, landing, part.schema))
        streams.run_to_parquet(stream, out, mark)
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(out).collect()))


def test_triggers(spark, halves, tmp_path):
    got = two_runs(spark, halves, lambda s: streams.trigger_stream(s, CFG), tmp_path)
    assert got == sorted(map(tuple, examples.chat_triggers(halves[0], CFG).collect()))


def step_runs(spark, parts, run, tmp_path, schema, **options):
    """Land each list of tables, a run after each; the results of all runs."""
    landing, out, work = (str(tmp_path / x) for x in ("landing", "out", "work"))
    for part in parts:
        for df in part:
            df.coalesce(1).write.mode("append").parquet(landing)
        run(streams.read_stream(spark, landing, part[0].schema, **options), out, work)
    return sorted(map(tuple, streams.read_results(spark, out, schema).collect()))


CONTEXT = "messageid long, channelid long, context string"


def run_context(stream, out, work):
    streams.context_run(stream, CFG, out, work)


def run_gate(stream, out, work):
    streams.gate_run(streams.trigger_stream(stream, CFG), BUSY, out, work)


def test_gate(spark, halves, tmp_path):
    batch = gate.trigger_gate(examples.chat_triggers(halves[0], CFG), BUSY)
    got = step_runs(spark, [[halves[1]], [halves[2]]], run_gate, tmp_path, batch.schema)
    assert got == sorted(map(tuple, batch.collect()))


def test_context(spark, halves, tmp_path):
    got = step_runs(spark, [[halves[1]], [halves[2]]], run_context, tmp_path, CONTEXT)
    assert got == sorted(map(tuple, examples.chat_context(halves[0], CFG).collect()))


@pytest.mark.parametrize("max_bytes", [1, 1 << 30])
def test_order_of_files_and_batch_size_do_not_matter(spark, halves, tmp_path, max_bytes):
    parts = [halves[0].filter(f"day(sent) BETWEEN {day} AND {day + 9}") for day in (21, 11, 1, 31)]
    got = step_runs(spark, [parts], run_context, tmp_path, CONTEXT, max_bytes=max_bytes)
    assert got == sorted(map(tuple, examples.chat_context(halves[0], CFG).collect()))


def test_a_row_of_a_later_run_is_not_seen(spark, halves, tmp_path):
    m = halves[0]
    trigger = m.filter("content LIKE '/kc%' AND userid <> 4").orderBy("sent").first()
    own = m.filter(m.channelid == trigger.channelid)
    last = own.filter(own.messageid == trigger.messageid)
    before = own.filter(own.sent < trigger.sent)
    got = step_runs(spark, [[last], [before]], run_context, tmp_path, CONTEXT)
    assert [r[2] for r in got if r[0] == trigger.messageid][0].count("\n") == 0


def test_many_names_work_on_a_stream(spark, halves, tmp_path):
    cfg = replace(CFG, names={**CFG.names, **{f"x{i}": f"n{i}" for i in range(3_000)}})
    got = step_runs(spark, [[halves[1]]], lambda s, o, w: streams.context_run(s, cfg, o, w), tmp_path, CONTEXT)
    assert got == sorted(map(tuple, examples.chat_context(halves[1], CFG).collect()))


def test_an_empty_run_writes_nothing(spark, halves, tmp_path):
    landing, out, work = (str(tmp_path / x) for x in ("landing", "out", "work"))
    halves[1].write.parquet(landing)
    for _ in range(2):
        run_context(streams.read_stream(spark, landing, halves[1].schema), out, work)
    assert streams.read_results(spark, out, CONTEXT).count() == examples.chat_triggers(halves[1], CFG).count()


def test_backfill_of_a_new_channel(spark, tmp_path):
    from test_conversations import frame
    everything = random_lists(3, channels=3, size=20)
    landing, table, mark = (str(tmp_path / x) for x in ("landing", "table", "mark"))
    newest = max(m.channelid for m in everything)
    parts = [[m for m in everything if m.channelid == newest],
             [m._replace(t=m.t - 10**13) for m in everything if m.channelid != newest]]
    for part in (*parts, parts[0]):
        df = frame(spark, part).selectExpr("*", "true AS isFirstInConvers")
        df.write.mode("append").parquet(landing)
        runs.ingest_run(spark, landing, table, mark, df.schema)
    ids = [r.messageid for r in read_messages(spark, table, schema=df.schema).collect()]
    assert sorted(ids) == sorted(m.messageid for m in everything)


@pytest.mark.parametrize("late", [False, True])
def test_ingest_and_assign_runs(spark, tmp_path, late):
    from test_conversations import frame
    everything = random_lists(4, channels=3, size=30)
    landing, table, mark, done = (str(tmp_path / x) for x in ("landing", "table", "mark", "done"))
    cut = 50 * HOUR
    first = lambda m: m.t < cut and not (late and m.messageid % 4 == 0)
    parts = [[m for m in everything if first(m)], [m for m in everything if not first(m)]]
    repeated = parts[0][-3:]
    stored = []
    for part in (parts[0], parts[1] + repeated):
        df = frame(spark, part)
        df = df.selectExpr("*", "true AS isFirstInConvers")
        df.write.mode("append").parquet(landing)
        runs.ingest_run(spark, landing, table, mark, df.schema)
        runs.assign_run(spark, table, done, CFG, df.schema)
        new = [m for m in part if m.messageid not in {s.messageid for s in stored}]
        found = assign(stored + new)
        stored += [m._replace(conversid=found[m.messageid][0]) for m in new]
        got = read_messages(spark, done, schema=df.schema).collect()
        assert sorted((r.messageid, r.conversid) for r in got) == sorted((m.messageid, m.conversid) for m in stored)


@pytest.mark.parametrize("name", ["stream_ingest", "stream_ingest_backfill"])
def test_tables_land_without_passing_one_task(spark, monkeypatch, name):
    def coalesce(df, n):
        raise AssertionError(f"{n} tasks")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", coalesce)
    sf = "/root/testdata/sf0.001"
    rows = registry.QUERIES[name](spark, sf)
    assert rows.count() == rows.select("messageid").distinct().count() == messages(spark, sf, replies=False).count()
