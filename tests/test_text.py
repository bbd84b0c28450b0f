"""Scrubbing against the same rules written with Python's ``re``."""

import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.functions import text as X
from threadloom.operators import scrub

CFG = ChatConfig(bot_id=4, user_id=2, names={"1": "A$AP", "2": "Bo\\b", "11": "Eleven"})

# Inputs and training outputs listed in FIXTURES.md.
PARITY = [
    ("awwww cute", "a cute"), ("see <https://x.y/z> ok", "see < ok"), ("a < b <:s:1>", "a"),
    ("<@1> hi <:e:22> z", "z"), ("<t:1618953630> <t:16189:R>", "<t:16189:R>"),
    ("<@1> x <@2> y <@1>", "A$AP x A$AP"), ("<@1> <@11>", "A$AP A$AP"), ("<@everyone> <@2>", "Bo\\b"),
    ("a\xa0\xa0b \n c\u2028d\r\ne", "a b \n c d \ne"), ("\u2003 q \x1c\n", "q"),
    ("<@!2>|<#1>|<@&9>", "Bo\\b|A$AP|"), ("<:a\rb:12>", ""), ("xhttp y", "xhttp y"), ("\x1c\x1fz", "z"),
    ("<@\u0661>", ""), ("ht<:a:1>tps://x", "https://x"),
]


def rules(text, author, training):
    """The scrub in Python; names count as literal text."""
    if training and (text.startswith("/kc") or author == CFG.bot_id):
        return ""
    if not training:
        text = text.replace(str(CFG.bot_id), str(CFG.user_id))
        text = text.removeprefix("/kc ").strip() if text.startswith("/kc ") else text
    for junk in (r"(?:http|www)\S+", r"<.+?:\d+>"):
        text = re.sub(junk, "", text)
    for found in re.findall(r"<[#@].*?(\d+?)>", text):
        text = re.sub(rf"<[#@].*?{found}>", lambda _: CFG.names.get(found, ""), text)
    return re.sub(r"[^\S\n]+", " ", text).strip()


def random_texts(n):
    rng = random.Random(3)
    bits = ["<", ">", "@", "#", ":", "1", "2", "4", "a", "\n", "\r", "\xa0", " ", "\t", "<@1>", "<@!11>", "<:e:1>",
            "http", "www", "/kc", "/kc ", "\u2028", "\x1d", "\u0663", "\x85", "\u180e", "\u200b", "\u3000"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    data = [p for p, _ in PARITY] + random_texts(4000)
    rows = [(i, [1, 2, 4][i % 3] if i >= len(PARITY) else 1, t) for i, t in enumerate(data)]
    return rows, spark.createDataFrame(rows, "messageid long, userid long, content string")


def cleaned(df, training, **options):
    return {r.messageid: r.content for r in scrub.clean_messages(df, CFG, training, **options).collect()}


def test_listed_inputs(texts):
    got = cleaned(texts[1], True)
    assert [got[i] for i in range(len(PARITY))] == [out for _, out in PARITY]


@pytest.mark.parametrize("training", [True, False])
def test_random_inputs(texts, training):
    rows, df = texts
    got = cleaned(df, training)
    assert [(t, got[i]) for i, _, t in rows] == [(t, rules(t, a, training)) for i, a, t in rows]


def test_joined_names_equal_inlined_names(spark, texts):
    names = scrub.names_table(texts[1], CFG)
    for training in (True, False):
        assert cleaned(texts[1], training, names=names) == cleaned(texts[1], training)
    authors = [CFG.bot_id, 1, 2, 11]
    some = texts[1].withColumn("userid", F.element_at(F.array(*map(F.lit, authors)), (F.col("messageid") % 4 + 1).cast("int")))
    inlined = {tuple(r) for r in scrub.format_messages(some, CFG, True).collect()}
    assert inlined == {tuple(r) for r in scrub.format_messages(some, CFG, True, names).collect()}


def test_format(spark):
    df = spark.createDataFrame([(1, 1, "x"), (2, 4, "y"), (3, 2, "")], "messageid long, userid long, content string")
    live = dict(map(tuple, scrub.format_messages(df, CFG, training=False).collect()))
    assert live == {1: "A$AP: x", 2: "Bo\\b: y"}
    training = dict(map(tuple, scrub.format_messages(df, CFG, training=True).collect()))
    assert training == {1: "A$AP: x", 2: f"{CFG.bot_label}: y"}


def test_author_without_name(spark):
    df = spark.createDataFrame([(1, 7, "x"), (2, 1, "y"), (3, 8, "")], "messageid long, userid long, content string")
    with pytest.raises(PySparkException, match="no name for author 7"):
        scrub.format_messages(df, CFG, True).collect()
    by_id = ChatConfig(4, 2, CFG.names, on_missing_name="id")
    assert dict(map(tuple, scrub.format_messages(df, by_id, True).collect())) == {1: "7: x", 2: "A$AP: y"}
    drop = ChatConfig(4, 2, CFG.names, on_missing_name="drop")
    assert dict(map(tuple, scrub.format_messages(df, drop, True).collect())) == {2: "A$AP: y"}


def test_clean_flags(spark):
    df = spark.createDataFrame(
        [(1, 1, "same"), (2, 1, "two  blanks"), (3, 1, "/kc x"), (4, 1, "")], "messageid long, userid long, content string")
    flags = {r.messageid: (r.is_changed, r.is_empty) for r in scrub.clean_flags(df, CFG).collect()}
    assert flags == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, True)}


def test_no_names_at_all(spark):
    df = spark.createDataFrame([("a <@1> b",)], "content string")
    assert df.select(X.replace_mentions(F.col("content"), X.names_map({}))).first()[0] == "a  b"
