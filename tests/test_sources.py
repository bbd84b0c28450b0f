"""Sources, sinks, settings and checks."""

import json
from datetime import datetime

import pytest
from model import HOUR, Msg
from pyspark.sql import functions as F
from test_conversations import CFG, frame

from threadloom.functions.times import format_sent, parse_sent
from threadloom.operators.checks import unresolved_refs
from threadloom.schema import EXAMPLE, MESSAGE, create_message_table
from threadloom.sources import messages as M
from threadloom.sources.examples import read_examples, write_examples
from threadloom.sources.names import load_config, read_names
from threadloom.storage import shared_folder


def test_raw_messages(spark, tmp_path):
    raw = [
        {"id": 5, "channel": {"id": 1, "name": "general"}, "author": {"id": 2, "name": "t"},
         "created_at": "2024-01-02 03:04:05.678900+00:00", "content": "hi", "reference": {"message_id": 4}},
        {"id": 6, "channel": {"id": 1, "name": "general"}, "author": {"id": 3, "name": "j"},
         "created_at": "2024-01-02 03:04:05+00:00", "content": "", "reference": None},
        {"id": 7, "channel": {"id": 1, "name": "general"}, "author": {"id": 3, "name": "j"},
         "created_at": "2024-01-02 09:34:05+0530", "content": "x"},
    ]
    (tmp_path / "day.json").write_text("\n".join(map(json.dumps, raw)))
    df = M.read_raw(spark, str(tmp_path))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in MESSAGE]
    rows = {r.messageid: r for r in df.select("*", format_sent(df.sent).alias("text")).collect()}
    assert [rows[i].replyid for i in (5, 6, 7)] == [4, None, None]
    assert rows[5].text == "2024-01-02 03:04:05.678900+00:00"
    assert rows[6].text == "2024-01-02 03:04:05+00:00"
    assert rows[7].text == "2024-01-02 04:04:05+00:00"
    assert {(r.conversid, r.isFirstInConvers) for r in rows.values()} == {(-1, True)}


def test_lines_that_are_no_message_are_listed(spark, tmp_path):
    good = json.dumps({"id": 1, "channel": {"id": 1, "name": "a"}, "author": {"id": 1, "name": "b"},
                       "created_at": "2024-01-02 03:04:05+00:00", "content": "x"})
    (tmp_path / "day.json").write_text(good + "\n{broken\n")
    assert [r.messageid for r in M.read_raw(spark, str(tmp_path)).collect()] == [1]
    assert [r.line for r in M.unreadable_lines(spark, str(tmp_path)).collect()] == ["{broken"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_need_an_offset_and_show_utc_in_any_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-01-01 12:00:00+00:00", "2024-03-10 02:30:00.5-0500", "2024-01-01 12:00:00", "2024", "2024-01-01"]
        df = spark.createDataFrame([(t,) for t in texts], "s string")
        got = [r[0] for r in df.select(format_sent(parse_sent(df.s))).collect()]
        assert got == ["2024-01-01 12:00:00+00:00", "2024-03-10 07:30:00.500000+00:00", None, None, None]
        wall = df.limit(1).select(F.expr("timestamp_ntz'2024-03-10 02:30:00'").alias("w"))
        assert wall.select(format_sent(wall.w)).first()[0] == "2024-03-10 02:30:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_names_may_be_odd_repeated_and_many(spark):
    from threadloom.config import ChatConfig
    from threadloom.operators import scrub
    cfg = ChatConfig(bot_id=4, user_id=2, names={"1": "Ann", "2": "Tom", "no number": "x", **{f"a{i}": "y" for i in range(2_500)}})
    rows = spark.createDataFrame([(1, 1, "hi <@2>"), (2, 2, "yo")], "messageid long, userid long, content string")
    names = scrub.names_table(rows, cfg)
    for given in (None, names, names.unionByName(names)):
        cleaned = scrub.clean_messages(rows, cfg, True, names=given)
        got = sorted(map(tuple, scrub.format_messages(cleaned, cfg, True, names=given).collect()))
        assert got == [(1, "Ann: hi Tom"), (2, "Tom: yo")]


def test_bad_time_is_null(spark):
    df = spark.createDataFrame([("yesterday",)], "s string")
    assert df.select(parse_sent(df.s)).first()[0] is None


def test_absent_folder_is_an_empty_table(spark, tmp_path):
    df = M.read_messages(spark, str(tmp_path / "none"))
    assert df.count() == 0 and df.columns == MESSAGE.fieldNames()


def test_append_and_prune(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, i % 3, "c", 1, "u", datetime(2024, 1, 1, i), "x", None, -1, True) for i in range(6)]
    M.append_messages(spark.createDataFrame(rows[:3], MESSAGE), path)
    M.append_messages(spark.createDataFrame(rows[3:], MESSAGE), path)
    df = M.read_messages(spark, path).select(*MESSAGE.fieldNames())
    assert sorted(map(tuple, df.collect())) == rows
    plan = df.filter("channelid = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(channelid), EqualTo(channelid,1)" in plan and "bucket" not in df.columns


def test_ingest_takes_the_oldest_new_ones(spark):
    stored = frame(spark, [Msg(1, 1, 1, 0), Msg(2, 1, 1, HOUR)])
    landing = frame(spark, [Msg(1, 1, 1, 0), Msg(2, 1, 1, HOUR), Msg(3, 1, 1, HOUR), Msg(4, 1, 1, 2 * HOUR),
                            Msg(5, 1, 1, 3 * HOUR), Msg(9, 1, 1, HOUR // 2), Msg(6, 2, 1, 0)])
    got = sorted(r.messageid for r in M.incremental_ingest(landing, stored, 2).collect())
    assert got == [3, 4, 6]


def test_names_and_settings(spark, tmp_path):
    names = {"10": "general", "2": "Tom"}
    (tmp_path / "names.json").write_text(json.dumps(names, indent=4))
    assert dict(map(tuple, read_names(spark, str(tmp_path / "names.json")).collect())) == names
    settings = {"botToken": "-", "botID": "4", "userToImpersonateID": "2", "guildID": "1", "channelIDs": ["10", "9"]}
    cfg, channels = load_config(json.dumps(settings), json.dumps(names))
    assert (cfg.bot_id, cfg.user_id, cfg.user_name, channels) == (4, 2, "Tom", [10, 9])
    assert [tuple(r) for r in M.channel_list(spark, channels).collect()] == [(0, 10), (1, 9)]
    table = spark.createDataFrame([(["10", "x", "9"],)], "ids array<string>")
    assert [tuple(r) for r in M.channels_of(table, "ids").collect()] == [(0, 10), (1, None), (2, 9)]


def test_bad_options_are_refused():
    from threadloom.config import ChatConfig
    with pytest.raises(ValueError):
        ChatConfig(4, 2, on_missing_name="guess")
    with pytest.raises(ValueError):
        ChatConfig(4, 2, on_missing_reply="guess")


def test_examples_survive_json(spark, tmp_path):
    rows = [(1, 2, "do", "a: \"x\"\nb: é", "c\\n"), (1, 3, "do", " ", "z")]
    write_examples(spark.createDataFrame(rows, EXAMPLE), str(tmp_path / "ex"))
    assert sorted(map(tuple, read_examples(spark, str(tmp_path / "ex")).collect())) == rows


def test_table_is_created_once(spark, tmp_path):
    where = f"{tmp_path}/catalog_messages"
    for _ in range(2):
        create_message_table(spark, "chat_messages_test", where)
    assert spark.table("chat_messages_test").columns == MESSAGE.fieldNames()
    spark.sql("DROP TABLE chat_messages_test")


def test_unresolved(spark):
    df = frame(spark, [Msg(1, 1, 1, 0), Msg(2, 1, 7, 1, 1), Msg(3, 5, 4, 2, 1), Msg(4, 5, 7, 3, 99)])
    names = spark.createDataFrame([("1", "Ann")], "id string, name string")
    got = dict(map(tuple, unresolved_refs(df, names, CFG).collect()))
    assert got == {"author": 2, "channel": 2, "reply_target": 2, "sent": 0}


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (configured.rstrip("/") if configured else shared_folder(spark))
