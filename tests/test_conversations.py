"""Assignment against the model, both in plain windows and with every large group split."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from model import GAP, HOUR, Msg, assign
from pyspark.errors import PySparkException

from threadloom.config import ChatConfig
from threadloom.operators import conversations as C
from threadloom.operators.ordered import Ordered

CFG = ChatConfig(bot_id=4, user_id=2, names={"2": "Tom"})
SPLIT_CFG = replace(CFG, max_group_rows=6)
START = datetime(2024, 1, 1)


def frame(spark, messages):
    rows = [(m.messageid, m.channelid, m.userid, START + timedelta(microseconds=m.t), m.replyid, m.conversid)
            for m in messages]
    return spark.createDataFrame(
        rows, "messageid long, channelid long, userid long, sent timestamp_ntz, replyid long, conversid long")


def as_dict(df):
    return {r.messageid: (r.conversid, r.isFirstInConvers) for r in df.collect()}


def edge_lists():
    """One edge case per channel."""
    ids = iter(range(1, 10**6))

    def channel(number, *rows):
        made = []
        for user, t, *reply in rows:
            target = reply[0] if reply else None
            replyid = made[target].messageid if isinstance(target, int) else (10**9 if target == "lost" else None)
            made.append(Msg(next(ids), number, user, t, replyid))
        return made

    out = []
    out += channel(1, (1, 0), (2, GAP), (1, 2 * GAP))                      # exactly the gap: one conversation
    out += channel(2, (1, 0), (2, GAP + 1))                                 # a microsecond more: two
    out += channel(3, *[(1, h * HOUR) for h in range(30)])                  # monologue, cut from its anchor
    out += channel(4, *[(1 if h != 13 else 2, h * HOUR) for h in range(30)])  # author change inside it
    out += channel(5, (1, 0), (2, 9 * HOUR), (1, 10 * HOUR, 0), (2, 11 * HOUR))  # reply takes the next along
    out += channel(6, (1, 0), *[(1 + i % 3, i * 9 * HOUR, i - 1) for i in range(1, 51)])  # chain of replies
    out += channel(7, (1, 0, "lost"), (2, HOUR))                            # first is a reply to nothing
    out += channel(8, (1, 0), (2, 9 * HOUR, "lost"), (2, 30 * HOUR, "lost"))  # lost replies do break
    out += channel(9, (1, 0), (2, 0), (1, 0), (2, 9 * HOUR), (1, 9 * HOUR))  # equal times
    elsewhere = next(m for m in out if m.channelid == 5)
    out.append(Msg(next(ids), 10, 1, 0))
    out.append(Msg(next(ids), 10, 2, 20 * HOUR, elsewhere.messageid))       # target in another channel
    later = next(ids)
    out.append(Msg(next(ids), 11, 1, 0))
    out.append(Msg(next(ids), 11, 1, 9 * HOUR, later))                      # target not sent yet
    out.append(Msg(later, 11, 1, 10 * HOUR))
    out += channel(12, (1, 0), *[(1, (4 + 5 * i) * HOUR, i) for i in range(9)])  # monologue of replies
    return out


def random_lists(seed, channels=6, size=60, scale=3 * HOUR):
    rng = random.Random(seed)
    out, ids = [], 0
    for channel in range(100, 100 + channels):
        t, mine = 0, []
        users = rng.choice([1, 2, 4])
        for _ in range(size):
            t += rng.choice([0, scale // 10, scale, 2 * scale, 3 * scale, GAP, GAP + 1])
            reply = rng.choice(mine).messageid if mine and rng.random() < 0.2 else None
            mine.append(Msg(ids, channel, rng.randint(1, users), t, reply))
            ids += 1
        out += mine
    return [m._replace(messageid=m.messageid + 10**6,
                       replyid=None if m.replyid is None else m.replyid + 10**6) for m in out]


@pytest.fixture(scope="module")
def everything():
    return edge_lists() + random_lists(1) + [
        m._replace(messageid=m.messageid + 10**6, channelid=m.channelid + 50,
                   replyid=None if m.replyid is None else m.replyid + 10**6)
        for m in random_lists(2, scale=HOUR)]


@pytest.mark.parametrize("cfg", [CFG, SPLIT_CFG], ids=["plain", "split"])
def test_assign_matches_model(spark, everything, cfg):
    got = as_dict(C.assign_conversations(frame(spark, everything), cfg))
    assert got == assign(everything)
    assert set(got) == {m.messageid for m in everything}
    openings = [conv for conv, opens in got.values() if opens]
    assert sorted(openings) == list(range(len(openings))) == sorted({conv for conv, _ in got.values()})


def test_split_config_really_splits(spark, everything):
    timeline = C._timeline(frame(spark, everything), SPLIT_CFG)
    assert isinstance(timeline, Ordered) and timeline.split
    assert timeline.rows.select("_chunk").distinct().count() > 20


def test_listed_channels_in_given_order(spark, everything):
    order = [3, 1, 105, 6]
    channels = spark.createDataFrame(list(enumerate(order)), "ordinal int, channelid long")
    got = as_dict(C.assign_conversations(frame(spark, everything), CFG, channels))
    assert got == assign([m for m in everything if m.channelid in order], order)


@pytest.mark.parametrize("cfg", [CFG, SPLIT_CFG], ids=["plain", "split"])
def test_incremental_matches_model(spark, everything, cfg):
    cut = 40 * HOUR
    prior = [m for m in everything if m.t < cut]
    first = assign(prior)
    stored = [m._replace(conversid=first[m.messageid][0]) for m in prior]
    new = [m for m in everything if m.t >= cut]
    got = as_dict(C.assign_new(frame(spark, new), frame(spark, stored), cfg))
    assert got == assign(stored + new)


def test_incremental_with_late_messages(spark):
    stored = [Msg(1, 1, 1, 0, None, 0), Msg(2, 1, 2, 20 * HOUR, None, 1), Msg(3, 1, 1, 40 * HOUR, None, 2)]
    new = [Msg(4, 1, 1, 21 * HOUR), Msg(5, 1, 1, 30 * HOUR), Msg(6, 1, 2, 41 * HOUR, 1), Msg(7, 1, 2, 60 * HOUR)]
    got = as_dict(C.assign_new(frame(spark, new), frame(spark, stored), CFG))
    assert got == assign(stored + new)


def test_missing_target_can_be_an_error(spark):
    lost = frame(spark, [Msg(1, 1, 1, 0), Msg(2, 1, 2, HOUR, 99)])
    with pytest.raises(PySparkException, match="no usable reply target for message 2"):
        C.assign_conversations(lost, replace(CFG, on_missing_reply="error")).collect()


def test_empty_table(spark):
    assert as_dict(C.assign_conversations(frame(spark, []), CFG)) == {}


@pytest.mark.parametrize("cfg", [CFG, SPLIT_CFG], ids=["plain", "split"])
def test_views_on_the_timeline(spark, everything, cfg):
    lines = {}
    for m in sorted(everything, key=lambda m: (m.t, m.messageid)):
        lines.setdefault(m.channelid, []).append(m)
    df = frame(spark, everything)
    previous = {r.messageid: (r.prev_messageid, r.prev_userid) for r in C.prev_message(df, cfg).collect()}
    runs = {r.messageid: (r.run, r.anchor_sent) for r in C.author_runs(df, cfg).collect()}
    for line in lines.values():
        run = 0
        anchor = None
        for i, m in enumerate(line):
            before = line[i - 1] if i else None
            assert previous[m.messageid] == ((before.messageid, before.userid) if before else (None, None))
            if before is None or before.userid != m.userid:
                run += 1
                anchor = START + timedelta(microseconds=before.t) if before else None
            assert runs[m.messageid] == (run, anchor)
