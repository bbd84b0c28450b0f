"""Examples, context, prompts and splits."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.functions import prompts
from threadloom.operators import aggregates, examples, gate, splits
from threadloom.plans.fixture import CFG as FIXTURE_CFG
from threadloom.plans.fixture import messages as fixture_messages
from threadloom.plans.prepare import prepare_examples

CFG = ChatConfig(bot_id=4, user_id=2, names={"1": "Ann", "2": "Tom", "3": "Jo"})
SCHEMA = "messageid long, conversid long, channelid long, userid long, sent long, content string, isFirstInConvers boolean"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chat(spark):
    rng = random.Random(9)
    data = []
    for i in range(300):
        conv = 0 if i % 3 else rng.randint(-1, 6)
        data.append((i, conv, conv % 2, rng.randint(1, 4), i, rng.choice(["", "", "x", f"t{i}", "/kc hi"]),
                     not any(d[1] == conv for d in data)))
    return data, spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("limit", [10**6, 12])
def test_training_examples(chat, limit):
    data, df = chat
    expected = {}
    for m in data:
        if m[1] == -1 or m[3] != 2 or m[5] == "" or m[6]:
            continue
        before = [p for p in data if p[1] == m[1] and p[4] < m[4]][-10:]
        lines = [f"{ {1: 'Ann', 2: 'Tom', 3: 'Jo', 4: CFG.bot_label}[p[3]]}: {p[5]}" for p in before if p[5]]
        if lines:
            expected[m[0]] = (m[1], CFG.instruction_text, "\n".join(lines), m[5])
    rows = examples.training_examples(df, replace(CFG, max_group_rows=limit)).collect()
    assert {r.messageid: (r.conversid, r.instruction, r.input, r.output) for r in rows} == expected
    assert len(rows) == len(expected) > 20


@pytest.mark.parametrize("limit", [10**6, 12])
def test_chat_context(chat, limit):
    data, df = chat
    expected = {}
    for m in data:
        if m[3] != 4 and m[5].startswith("/kc"):
            seen = [p for p in data if p[2] == m[2] and p[4] <= m[4]][-10:]
            texts = [(p[3], p[5].replace("4", "2").removeprefix("/kc ")) for p in seen]
            expected[m[0]] = "\n".join(f"{ {1: 'Ann', 3: 'Jo'}.get(u, 'Tom')}: {t}" for u, t in texts if t)
    rows = examples.chat_context(df, replace(CFG, max_group_rows=limit)).collect()
    assert {r.messageid: r.context for r in rows} == expected


def moved(df):
    """The columns of each shuffle of a plan."""
    plan = df._jdf.queryExecution().sparkPlan()
    ready = df.sparkSession._jvm.org.apache.spark.sql.execution.exchange.EnsureRequirements(
        getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.exchange.EnsureRequirements, "apply$default$1")(),
        getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.exchange.EnsureRequirements, "apply$default$2")()).apply(plan)
    found, todo = [], [ready]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
    return found


@pytest.mark.parametrize("limit", [10**6, 12])
def test_text_moves_once(spark, limit):
    """Only to the groups, and only for the rows that are needed."""
    cfg = replace(FIXTURE_CFG, max_group_rows=limit)
    rows = fixture_messages(spark, SF, replies=False)
    for found in (examples.chat_context(rows, cfg), prepare_examples(rows, cfg)):
        with_text = [m for m in moved(found) if m & {"content", "line"}]
        assert len(with_text) == 1 and "_pos" in with_text[0]


def test_needed_rows_too_many_to_send(chat, spark):
    _, df = chat
    want = [sorted(map(tuple, f(df, CFG).collect())) for f in (examples.training_examples, examples.chat_context)]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        got = [f(df, CFG) for f in (examples.training_examples, examples.chat_context)]
        assert all("BroadcastHashJoin" not in f._jdf.queryExecution().sparkPlan().toString() for f in got)
        assert [sorted(map(tuple, f.collect())) for f in got] == want
    finally:
        spark.conf.set(limit, before)


def test_split_run_over_the_fixture(spark):
    small = replace(FIXTURE_CFG, max_group_rows=25)
    whole = prepare_examples(fixture_messages(spark, SF), FIXTURE_CFG).collect()
    parts = prepare_examples(fixture_messages(spark, SF, cfg=small), small).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and whole


def test_prompts(spark):
    df = spark.createDataFrame([(1, "Be Tom.", "Ann: ### Response:\nhi", "yo")],
                               "messageid long, instruction string, input string, output string")
    row = examples.render_training(df).first()
    assert row.prompt == ("### Instruction:\nBe Tom.\n\n### Input:\nAnn: ### Response:\nhi\n\n### Response:\nyo")
    assert row.prompt[row.completion_start:] == "yo"
    live = examples.render_inference(df.select("messageid", F.col("input").alias("context")), CFG).first()
    assert live.prompt.startswith(f"### Instruction:\n{CFG.instruction_text}\n\n### Input:\nAnn")
    assert live.prompt.endswith("hi\n\n### Response:\n")


def test_first_candidate(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(prompts.first_candidate(F.col("c"))).collect()] == ["a", None]


def test_impersonated_member_must_be_named():
    with pytest.raises(KeyError):
        ChatConfig(4, 2, {"1": "Ann"}).instruction_text


@pytest.mark.parametrize("n", [0, 1, 7, 25, 105])
def test_folds(spark, n):
    folded = splits.with_own_fold(spark.range(n).select(F.col("id").alias("messageid")), ["messageid"])
    split = splits.kfold_split(folded).collect()
    assert len(split) == 10 * n
    val = {r.messageid: r.fold for r in split if r.split == "val"}
    assert len(val) == n and sum(r.split == "val" for r in split) == n
    for k in range(10):
        first, end = splits.percent_boundary(n, 10 * k), splits.percent_boundary(n, 10 * k + 10)
        assert [m for m in range(n) if val[m] == k] == list(range(first, end))
        assert {r.messageid for r in splits.fold(folded, k, "val").collect()} == set(range(first, end))
        assert splits.fold(folded, k, "train").count() == n - (end - first)
    sizes = {(r.fold, r.split): r.rows for r in splits.kfold_sizes(folded).collect()}
    for (k, kind), rows in sizes.items():
        assert rows == sum(r.fold == k and r.split == kind for r in split)


def test_halves_round_to_even():
    assert [splits.percent_boundary(n, 10) for n in (25, 35, 45)] == [2, 4, 4]


def test_random_split(spark):
    df = spark.range(101).select(F.col("id").alias("messageid"))
    rows = splits.random_split(df, F.xxhash64("messageid", F.lit(1))).collect()
    assert len(rows) == 101 and sum(r.split == "test" for r in rows) == 21


def test_latest_n(chat):
    data, df = chat
    got = {r.channelid: r["items"] for r in aggregates.latest_n_per_channel(df, 4, F.col("content")).collect()}
    assert got == {c: [m[5] for m in data if m[2] == c][-4:] for c in {m[2] for m in data}}


def test_gate_accepts_exactly_after_busy(spark):
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, i, start + timedelta(seconds=s)) for i, s in enumerate([0, 5, 10, 15, 20, 31])],
        "channelid long, messageid long, sent timestamp")
    kept = sorted(r.messageid for r in gate.trigger_gate(df, timedelta(seconds=10)).collect())
    assert kept == [0, 2, 4, 5]
