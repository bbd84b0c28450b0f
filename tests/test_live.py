"""What runs read, what survives failures, and live answers."""

import json
from datetime import datetime, timedelta

import pytest
from model import HOUR, assign
from test_conversations import frame, random_lists

from threadloom.operators import examples, gate
from threadloom.plans import registry
from threadloom.plans.fixture import CFG, SPLIT, messages
from threadloom.sources import messages as M
from threadloom.streaming import live, runs, streams

SF = "/root/testdata/sf0.001"
BUSY = timedelta(hours=30)
WIDTH = 10


def folders(df):
    return {int(f.split("/ids=")[1].split("/")[0]) for f in df.inputFiles() if "/ids=" in f}


def rows_of(spark, lists):
    return frame(spark, lists).selectExpr("*", "true AS isFirstInConvers")


def test_a_run_reads_only_the_folders_its_ids_fall_in(spark, tmp_path):
    m = messages(spark, SF, replies=False)
    table = str(tmp_path / "table")
    M.append_by_id(m, table, WIDTH)
    batch = m.filter("messageid BETWEEN 95 AND 118")
    left = M.not_stored(batch.unionByName(batch.selectExpr("*").withColumn("messageid", batch.messageid + 10_000_000)), table, WIDTH)
    assert folders(left) == {9, 10, 11}
    assert sorted(r.messageid for r in left.select("messageid").collect()) == [10_000_000 + i for i in range(95, 119)]
    scan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in "".join(x for x in scan.split("\n") if "ids=" in x)
    assert M.read_messages(spark, table, schema=m.schema).count() == m.count()


def landed(spark, tmp_path, parts, run):
    landing, table, mark, done = (str(tmp_path / x) for x in ("landing", "table", "mark", "done"))
    for part in parts:
        df = rows_of(spark, part)
        df.write.mode("append").parquet(landing)
        run(landing, table, mark, done, df.schema)
    return [(r.messageid, r.conversid) for r in M.read_messages(spark, done, schema=df.schema).collect()]


def test_a_run_looks_up_what_is_assigned_once(spark, tmp_path, monkeypatch):
    looked, plain = [], runs.not_stored
    monkeypatch.setattr(runs, "not_stored", lambda rows, path, width: looked.append(path) or plain(rows, path, width))
    everything = sorted(random_lists(8, channels=3, size=40), key=lambda m: m.t)

    def run(landing, table, mark, done, schema):
        runs.ingest_run(spark, landing, table, mark, schema, WIDTH)
        runs.assign_run(spark, table, done, CFG, schema, width=WIDTH)

    found = landed(spark, tmp_path, [everything[:60], everything[60:]], run)
    assert sorted(i for i, _ in found) == sorted(m.messageid for m in everything)
    assert looked == [str(tmp_path / "done")] * 2


def test_assignment_reads_what_it_touches(spark, tmp_path):
    everything = sorted(random_lists(8, channels=3, size=60), key=lambda m: m.t)
    first, second = everything[:150], everything[150:]
    landing, table, mark, done = (str(tmp_path / x) for x in ("landing", "table", "mark", "done"))
    df = rows_of(spark, first)
    df.write.parquet(landing)
    runs.ingest_run(spark, landing, table, mark, df.schema, WIDTH)
    runs.assign_run(spark, table, done, CFG, df.schema, width=WIDTH)
    new = rows_of(spark, second).select(*runs.NARROW)
    last = spark.read.parquet(f"{done}-work/last/0")
    targets = {m.replyid // WIDTH for m in second if m.replyid is not None}
    assert folders(runs._touched(spark, new, last, done, f"{done}-work", df.schema, WIDTH)) <= targets
    stored = {m.messageid // WIDTH for m in first}
    assert len(targets & stored) < len(stored)


@pytest.mark.parametrize("step", ["append_by_id", "drop_staged"])
def test_a_failed_assignment_run_is_made_good(spark, tmp_path, monkeypatch, step):
    everything = random_lists(9, channels=2, size=20)
    cut = 40 * HOUR
    parts = [[m for m in everything if m.t < cut], [m for m in everything if m.t >= cut]]
    broken = []

    def run(landing, table, mark, done, schema):
        runs.ingest_run(spark, landing, table, mark, schema, WIDTH)
        if broken:
            real = getattr(runs, step)

            def fail(*args):
                if step == "append_by_id":  # some folders come, others do not
                    real(args[0].filter("messageid % 2 = 0"), *args[1:])
                raise OSError("lost")
            monkeypatch.setattr(runs, step, fail)
            with pytest.raises(OSError):
                runs.assign_run(spark, table, done, CFG, schema, width=WIDTH)
            monkeypatch.setattr(runs, step, real)
        broken.append(1)
        runs.assign_run(spark, table, done, CFG, schema, width=WIDTH)

    got = landed(spark, tmp_path, parts, run)
    stored = []
    for part in parts:
        found = assign(stored + part)
        stored += [m._replace(conversid=found[m.messageid][0]) for m in part]
    assert sorted(got) == sorted((m.messageid, m.conversid) for m in stored)


def test_channels_listed_later_are_taken_up(spark, tmp_path):
    everything = random_lists(10, channels=3, size=15)
    ids = sorted({m.channelid for m in everything})
    lists = iter([ids[:1], ids[:2], ids, ids])

    def run(landing, table, mark, done, schema):
        runs.ingest_run(spark, landing, table, mark, schema, WIDTH)
        for _ in range(2):
            runs.assign_run(spark, table, done, CFG, schema, M.channel_list(spark, next(lists)), width=WIDTH)

    got = landed(spark, tmp_path, [everything[::2], everything[1::2]], run)
    assert sorted(i for i, _ in got) == sorted(m.messageid for m in everything)


def test_a_failed_ingest_run_stores_each_message_once(spark, tmp_path, monkeypatch):
    m = messages(spark, SF, replies=False)
    landing, table, work = (str(tmp_path / x) for x in ("landing", "table", "work"))
    m.write.parquet(landing)
    real = streams.drop_staged
    monkeypatch.setattr(streams, "drop_staged", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        streams.ingest(streams.read_stream(spark, landing, m.schema), table, work)
    monkeypatch.setattr(streams, "drop_staged", real)
    for _ in range(2):
        streams.ingest(streams.read_stream(spark, landing, m.schema), table, work)
    assert sorted(r.messageid for r in M.read_messages(spark, table, schema=m.schema).collect()) == sorted(r.messageid for r in m.collect())


def test_unreadable_lines_stand_aside_once(spark, tmp_path, monkeypatch):
    line = lambda i: json.dumps({"id": i, "channel": {"id": 1, "name": "a"}, "author": {"id": 1, "name": "b"},
                                 "created_at": "2024-01-02 03:04:05+00:00", "content": "x"})
    landing, table, unread, work = (tmp_path / x for x in ("landing", "table", "unread", "work"))
    landing.mkdir()
    (landing / "1.json").write_text("\n".join([line(1), "{broken", "", "  ", '{"content": "no id"}', line(2), "[1, 2]"]))
    real, failed = streams.flatten_raw, []

    def fail_once(raw):
        if not failed:
            failed.append(1)
            raise OSError("lost")
        return real(raw)

    monkeypatch.setattr(streams, "flatten_raw", fail_once)
    for _ in range(3):
        try:
            streams.ingest_json(streams.read_line_stream(spark, str(landing)), str(table), str(unread), str(work))
        except Exception:
            assert failed
    (landing / "2.json").write_text("\n".join([line(2), line(3), "{again"]))
    streams.ingest_json(streams.read_line_stream(spark, str(landing)), str(table), str(unread), str(work))
    assert sorted(r.messageid for r in M.read_messages(spark, str(table)).collect()) == [1, 2, 3]
    lost = sorted(r.line for r in streams.read_results(spark, str(unread), "line string").collect())
    assert lost == sorted(["{broken", '{"content": "no id"}', "[1, 2]", "{again"])


def answers(spark, tmp_path, parts, busy=None):
    landing, out, mark = (str(tmp_path / x) for x in ("landing", "out", "mark"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(landing)
        found = live.live_answers(streams.read_stream(spark, landing, part.schema), CFG, busy)
        streams.run_to_parquet(found, out, mark)
    return spark.read.schema(found.schema).parquet(out).collect()


def test_live_answers_in_order(spark, tmp_path):
    m = messages(spark, SF, replies=False)
    parts = [m.filter(m.sent < SPLIT), m.filter(m.sent >= SPLIT)]
    got = answers(spark, tmp_path / "all", parts)
    assert sorted((r.messageid, r.channelid, r.context) for r in got) == sorted(map(tuple, examples.chat_context(m, CFG).collect()))
    got = answers(spark, tmp_path / "busy", parts, BUSY)
    want = gate.trigger_gate(examples.chat_triggers(m, CFG), BUSY)
    assert sorted((r.channelid, r.messageid, r.sent) for r in got) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_late_messages(spark, tmp_path, kind):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    schema = f"messageid long, channelid long, userid long, sent {kind}, content string"
    part = lambda *rows: spark.createDataFrame([(i, 1, 1, at(t), c) for i, t, c in rows], schema)
    got = answers(spark, tmp_path, [
        part((5, 5, "five"), (3, 3, "three"), (6, 6, "/kc one")),
        part((2, 2, "/kc late"), (4, 4, "four")),  # a late trigger gives no answer, but is seen
        part((7, 7, "/kc two"), (8, 7, "after")),
    ])
    assert [(r.messageid, r.sent.replace(tzinfo=None), r.context) for r in sorted(got, key=lambda r: r.messageid)] == [
        (6, at(6), "Ann: three\nAnn: five\nAnn: one"),
        (7, at(7), "Ann: late\nAnn: three\nAnn: four\nAnn: five\nAnn: one\nAnn: two")]


@pytest.mark.parametrize("name", ["live_context", "live_gate"])
def test_weeks_land_without_passing_one_task(spark, monkeypatch, name):
    def coalesce(df, n):
        raise AssertionError(f"{n} tasks")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", coalesce)
    m = messages(spark, SF, replies=False)
    asked = examples.chat_triggers(m, CFG)
    want = asked if name == "live_context" else gate.trigger_gate(asked, BUSY)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(r.messageid for r in got.collect()) == sorted(r.messageid for r in want.collect())


def test_a_channel_costs_no_frame(monkeypatch):
    """Rows of a channel are lists; only answers make a frame, so channels without one are cheap."""
    class State:
        exists, kept = False, None
        get = property(lambda self: self.kept)

        def update(self, value):
            self.exists, self.kept = True, value

    state, run = State(), live._answer(2, None)
    part = live.pd.DataFrame({"channelid": 5, "messageid": [3, 1, 2], "t": [30, 10, 20], "line": ["c", None, "b"], "asked": [False] * 3})
    late = live.pd.DataFrame({"channelid": 5, "messageid": [4, 9], "t": [25, 40], "line": ["d", "e"], "asked": [True, True]})

    def frame(*args, **kwargs):
        raise AssertionError("a frame")

    with monkeypatch.context() as m:
        m.setattr(live.pd, "DataFrame", frame)
        m.setattr(live.pd, "concat", frame)
        assert list(run((5,), iter([part]), state)) == []
    assert state.kept == ([20, 30], [2, 3], ["b", "c"], None)
    [found] = run((5,), iter([late]), state)
    assert found.values.tolist() == [[9, 5, 40, "c\ne"]] and state.kept == ([30, 40], [3, 9], ["c", "e"], 40)
