"""Answering while messages arrive: busy gate and rolling context as keyed state.

State per channel is what an answer looks at: the newest ``history`` lines with their times and ids,
and when a trigger was last answered. It does not grow with the channel. Nothing waits for a
watermark; a micro-batch's rows of a channel are taken in order of (sent, messageid), whatever order
they came in, and its triggers are answered at once.

Lateness. A row is late if a newer one of its channel came in an earlier micro-batch. A late message
takes its place among the newest lines if it is one of them, so later answers see it. A late trigger
is not answered: the channel has moved on. So on data that lands in order the answers are those of
the batch operators, however it is cut into micro-batches and runs. Landing must not repeat messages.
"""

from __future__ import annotations

from bisect import bisect_right
from datetime import timedelta
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import TimestampNTZType

from threadloom.config import ChatConfig
from threadloom.functions.times import micros, to_micros
from threadloom.operators.examples import is_trigger
from threadloom.operators.scrub import clean_messages, with_line

STATE = "times array<bigint>, ids array<bigint>, lines array<string>, answered bigint"
ANSWER = "messageid bigint, channelid bigint, t bigint, context string"


def _answer(history: int, busy: int | None):
    """The state function: all rows of a channel in a micro-batch to the answers given."""
    def run(key, parts, state: GroupState):
        # Channels are many and their rows few, so plain lists: a frame's operations cost more than these.
        new = []
        for p in parts:
            new += zip(map(int, p["t"].tolist()), map(int, p["messageid"].tolist()), p["line"].tolist(), p["asked"].tolist())
        kept, answered = [], None
        if state.exists:
            times, ids, lines, answered = state.get
            kept = [(t, i, line, False) for t, i, line in zip(times, ids, lines)]
        new.sort(key=itemgetter(0, 1))
        if kept:
            on_time = bisect_right(new, kept[-1][:2], key=itemgetter(0, 1))
            if late := [(t, i, line, False) for t, i, line, _ in new[:on_time]]:
                # Late rows stand among the kept ones, of which the newest stay.
                kept = sorted(kept + late, key=itemgetter(0, 1))[-history:]
                new = new[on_time:]
        rows = kept + new
        found = []
        for n, (t, i, _, asked) in enumerate(rows):
            if asked and (busy is None or answered is None or t - answered >= busy):
                answered = t
                seen = [line for _, _, line, _ in rows[max(0, n + 1 - history):n + 1] if isinstance(line, str)]
                found.append((i, key[0], t, "\n".join(seen)))
        rows = rows[-history:]
        state.update(([r[0] for r in rows], [r[1] for r in rows], [r[2] if isinstance(r[2], str) else None for r in rows], answered))
        if found:
            yield pd.DataFrame(found, columns=["messageid", "channelid", "t", "context"])

    return run


def live_answers(stream: DataFrame, cfg: ChatConfig, busy: timedelta | None = None) -> DataFrame:
    """(messageid, channelid, sent, context) of each trigger that is answered, as a stream to append.

    Without ``busy`` every trigger that is not late is answered; with it, one that comes within
    ``busy`` of the channel's last answered one is not.
    """
    sent = stream.schema["sent"].dataType
    asked = stream.withColumn("asked", is_trigger(cfg)).withColumn("t", micros(stream, "sent"))
    lines = with_line(clean_messages(asked, cfg, False), cfg, False).select("channelid", "messageid", "t", "line", "asked")
    found = lines.groupBy("channelid").applyInPandasWithState(
        _answer(cfg.history, None if busy is None else to_micros(busy)), ANSWER, STATE, "append", GroupStateTimeout.NoTimeout)
    at = (F.expr("timestampadd(MICROSECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00')") if isinstance(sent, TimestampNTZType)
          else F.timestamp_micros("t"))
    return found.select("messageid", "channelid", at.alias("sent"), "context")
