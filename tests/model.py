"""Conversation assignment by definition, quadratic and on one list: the yardstick in tests."""

from __future__ import annotations

from collections import namedtuple

Msg = namedtuple("Msg", "messageid channelid userid t replyid conversid", defaults=(None, -1))
HOUR = 3600 * 1_000_000
GAP = 8 * HOUR


def assign(messages, channel_order=None, gap=GAP):
    """{messageid: (conversid, opens)} of the unassigned messages."""
    out = {}
    fresh = max([m.conversid for m in messages if m.conversid is not None], default=-1) + 1
    fresh = max(fresh, 0)
    channels = channel_order or sorted({m.channelid for m in messages})
    for channel in channels:
        line = sorted((m for m in messages if m.channelid == channel), key=lambda m: (m.t, m.messageid))
        place = {m.messageid: i for i, m in enumerate(line)}
        conv, opens = [], []
        for i, m in enumerate(line):
            if m.conversid not in (-1, None):
                conv.append(m.conversid)
                opens.append(False)
                continue
            target = place.get(m.replyid, i)
            is_reply = target < i
            if i == 0 or (not is_reply and m.t - anchor_time(line, opens, i) > gap):
                conv.append(fresh)
                opens.append(True)
                fresh += 1
            else:
                conv.append(conv[target] if is_reply else conv[i - 1])
                opens.append(False)
            out[m.messageid] = (conv[i], opens[i])
    return out


def anchor_time(line, opens, i):
    """Time of the last message before the author's run, or of the last break in the run."""
    start = i
    while start > 0 and line[start - 1].userid == line[i].userid and line[start - 1].conversid in (-1, None):
        start -= 1
    broke = [b for b in range(start, i) if opens[b]]
    return line[broke[-1]].t if broke else line[max(start - 1, 0)].t
