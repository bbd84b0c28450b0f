"""Mentions in one pass, salted lookups, thinning, stored rewrites and SQL functions."""

import random
import re
import time

import pytest
from model import assign
from pyspark.sql import functions as F
from test_conversations import frame, random_lists
from test_live import folders  # noqa: F401

from threadloom.functions import text as X
from threadloom.operators import scrub
from threadloom.operators.thinning import greedy_thin
from threadloom.plans import surface
from threadloom.plans.fixture import CFG, messages
from threadloom.sources import snapshots as S

SF = "/root/testdata/sf0.001"
NAMES = {"1": "Ann", "2": "T$o\\m", "12": "", "3": "a1", "33": "x>y", "4": "<@1>", "5": "@5 "}


def by_definition(text, names):
    for i in re.findall(r"<[#@].*?(\d+?)>", text):
        text = re.sub(r"<[#@].*?" + i + ">", lambda _: names.get(i, ""), text)
    return text


def test_mentions_by_definition(spark):
    rng = random.Random(2)
    pieces = ["<@1>", "<@2>", "<@!3>", "<#12>", "<@33>", "<@4>", "<@5>", "<@77>", "<", ">", "1>", "@", " x ", "\n", "<@", "9", "<@everyone> ", "7>"]
    texts = ["".join(rng.choice(pieces[:10] if k % 3 else pieces) for _ in range(rng.randint(0, 7))) for k in range(4_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ids, names = X.mention_ids(F.col("t")), X.names_map(NAMES)
    got = df.select("t", X.replace_mentions(F.col("t"), names).alias("r"), (F.size(ids) > 0).alias("some"),
                    X.untangled(F.col("t"), ids, names).alias("plain")).collect()
    assert all(r.r == by_definition(r.t, NAMES) for r in got)
    plain = [r for r in got if r.some and r.plain]
    assert len(plain) > 300 and sum(r.some and not r.plain for r in got) > 300


def test_plain_mentions_need_no_pattern_of_the_row(spark):
    df = spark.createDataFrame([("hi <@1> and <@2>",)], "t string")
    fixed = X._replace_at_once(F.col("t"), X.mention_ids(F.col("t")), X.names_map(NAMES))
    assert "regexp_replace" not in str(fixed) and df.select(fixed).first()[0] == "hi Ann and T$o\\m"


def test_a_hot_mention_is_looked_up_in_many_tasks(spark):
    rows = spark.range(3_000).select(F.col("id").alias("messageid"), F.when(F.col("id") % 3 == 0, F.lit("<@1>")).otherwise(F.concat(F.lit("<@"), "id", F.lit(">"))).alias("t"))
    names = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", "c")], "id string, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = scrub.with_mention_names(rows, F.col("t"), names, "messageid")
        plan = found._jdf.queryExecution().sparkPlan().toString()
        got = {r.messageid: r._names for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[0] == {"1": "a"} and got[2] == {"2": "c"} and got[5] == {}
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "_salt" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    sides = [line for line in lines[at + 1:] if depth(line) <= depth(lines[at]) + 6]
    assert sides and not any("Aggregate" in line for line in sides)
    spread = rows.filter("messageid % 3 = 0").select(F.pmod(F.xxhash64("messageid"), F.lit(scrub.SALTS))).distinct().count()
    assert spread == scrub.SALTS


def test_thinning_of_one_large_group(spark):
    points = spark.range(1_000_000).selectExpr("1 AS k", "id * 10 AS t", "id AS messageid")
    greedy_thin(points.limit(10), ["k"], 5).count()
    begin = time.time()
    assert greedy_thin(points, ["k"], 5).count() == 1_000_000
    assert time.time() - begin < 20  # about 5 s on an idle machine


@pytest.mark.parametrize("seed", range(3))
def test_thinning_by_definition(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randint(0, 9_000), k * 10_000 + i) for k in range(3) for i in range(rng.choice([1, 15, 16, 17, 255, 256, 257, 900]))]
    kept = []
    for k in range(3):
        last = None
        for t, i in sorted((t, i) for g, t, i in rows if g == k):
            if last is None or t - last > 7:
                last = t
                kept.append(i)
    got = greedy_thin(spark.createDataFrame(rows, "k long, t long, messageid long"), ["k"], 7)
    assert sorted(r.messageid for r in got.collect()) == sorted(kept)


def test_rewrites_write_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "table")
    m = messages(spark, SF)
    S.create_snapshots(m, path)
    old = S.read_snapshot(spark, path, m.schema)
    one = m.filter("channelid = 7")
    changes = one.select("channelid", "messageid", F.lit("new").alias("content"))
    bucket = one.select(S.bucket_of()).first()[0]
    assert S.rewrite(spark, path, m.schema, changes) == [bucket]
    now = {r.messageid: r.content for r in S.read_snapshot(spark, path, m.schema).collect()}
    assert all((now[r.messageid] == "new") if r.channelid == 7 else now[r.messageid] == r.content for r in m.collect())
    # Who began to read before still can; the other buckets are the same files.
    assert sorted(r.content for r in old.collect()) == sorted(r.content for r in m.collect())
    again = set(S.read_snapshot(spark, path, m.schema).inputFiles()) & set(old.inputFiles())
    assert len(again) == len(old.inputFiles()) - len([f for f in old.inputFiles() if f"bucket={bucket}/" in f])
    assert S.rewrite(spark, path, m.schema, changes.limit(0)) == []
    S.rewrite_content(spark, path, m.schema, CFG)
    S.expire(spark, path, keep=1)
    assert S.read_snapshot(spark, path, m.schema).count() == m.count()
    with pytest.raises(ValueError):
        S.create_snapshots(m, path)


def test_a_failed_rewrite_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    m = messages(spark, SF)
    S.create_snapshots(m, path)
    changes = m.select("channelid", "messageid", F.lit("new").alias("content"))
    monkeypatch.setattr(S, "_names", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        S.rewrite(spark, path, m.schema, changes)  # data are written, their snapshot is not
    monkeypatch.undo()
    assert S.read_snapshot(spark, path, m.schema).filter("content = 'new'").count() == 0
    S.rewrite(spark, path, m.schema, changes)
    assert S.read_snapshot(spark, path, m.schema).filter("content = 'new'").count() == m.count()


def test_conversations_are_stored_over_two_rewrites(spark, tmp_path):
    everything = random_lists(6, channels=4, size=20)
    df = frame(spark, everything).selectExpr("*", "true AS isFirstInConvers")
    path = str(tmp_path / "table")
    S.create_snapshots(df, path)
    found = assign(everything)
    first, second = sorted({m.channelid for m in everything})[:2], sorted({m.channelid for m in everything})
    for ids in (first, second):
        channels = spark.createDataFrame([(n, c) for n, c in enumerate(ids)], "ordinal int, channelid long")
        S.rewrite_conversations(spark, path, df.schema, CFG, channels)
    got = {r.messageid: r.conversid for r in S.read_snapshot(spark, path, df.schema).collect()}
    assert got == {i: c[0] for i, c in found.items()}


def test_sql_functions_equal_the_columns(spark):
    surface.register_text(spark, CFG)
    parity = ["awwww cute", "see <https://x.y/z> ok", "a < b <:s:1>", "<@1> x <@2> y <@1>", "a\xa0\xa0b \n c d\r\ne", "  q \x1c\n",
              "<:a\rb:12>", "/kc  hi", "xhttp y", "it's \\ $1", ""]
    m = messages(spark, SF, replies=False).select("messageid", "userid", "content").unionByName(
        spark.createDataFrame([(10**9 + i, 1 + i % 3, t) for i, t in enumerate(parity)], "messageid long, userid int, content string"))
    m.createOrReplaceTempView("some_messages")
    for name, training in (("chat_clean", True), ("chat_clean_live", False)):
        got = spark.sql(f"SELECT messageid, {name}(content, userid) AS content FROM some_messages").collect()
        want = scrub.clean_messages(m, CFG, training).select("messageid", "content").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="no name for author 9"):
        spark.sql("SELECT chat_line(9, 'x')").collect()
