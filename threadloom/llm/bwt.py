"""Repeated strings of a set of short texts, by merging Burrows-Wheeler transforms.

Each shard of texts has its own transform: letters before its sorted suffixes, and for each row
the row of the suffix one letter longer. Merging refines an interleave of the shards' rows: after
h rounds it is sorted by the first h letters, each round being one stable pass by the letter
before. Where neighbours part in round h, their common prefix is h - 1 letters long. An interval of
one row is retired, since no longer suffix that ends in it can repeat. What is left after
``depth`` rounds are the intervals of suffixes that agree on ``depth`` letters. No suffix of one
shard is compared with one of another.
"""

from __future__ import annotations

import numpy as np

SHARD_LETTERS = 1 << 18


def _shard(letters: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Suffix order of a shard: prefix doubling, each text ending where ``last`` says."""
    n = len(letters)
    rank = letters.astype(np.int64) + 1
    at, width = np.arange(n), 1
    while True:
        reach = at + width
        after = np.where(reach <= last, rank[np.minimum(reach, n - 1)], 0)
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.cumsum(np.r_[1, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        same = new[-1] == n or width > (last - at).max(initial=0)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if same:
            return order
        width *= 2


def repeated(texts: list[np.ndarray], group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of each string of ``depth`` letters that starts elsewhere in its group as well.

    Letters are uint16; texts of different groups are never compared.
    """
    size = np.array([len(t) for t in texts], np.int64)
    if not len(size) or size.max() < depth:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(size)
    letters = np.concatenate(texts)
    last = np.repeat(ends - 1, size)
    first = np.repeat(ends - size, size)
    owner = np.repeat(np.arange(len(size)), size)
    # One transform a shard. A row of the merge is a place in these, shard after shard.
    suffix = np.empty(len(letters), np.int64)
    cuts = [0]
    for e in ends:
        if e - cuts[-1] >= SHARD_LETTERS or e == ends[-1]:
            a, b = cuts[-1], int(e)
            suffix[a:b] = a + _shard(letters[a:b], last[a:b] - a)
            cuts.append(b)
    row_of = np.empty_like(suffix)
    row_of[suffix] = np.arange(len(suffix))
    has = suffix > first[suffix]
    before = np.where(has, letters[suffix - 1], 0).astype(np.uint16)
    longer = np.where(has, row_of[suffix - 1], -1)
    # The first round takes each row by its own letter, shards one after another.
    row, block, letter = np.arange(len(suffix)), group[owner[suffix]], letters[suffix]
    order = np.lexsort((letter, block))
    row, block, letter = row[order], block[order], letter[order]
    for round_ in range(depth):
        if round_:
            able = longer[row] >= 0
            row, block = row[able], block[able]
            letter = before[row]
            order = np.argsort(letter, kind="stable")
            row, block, letter = longer[row[order]], block[order], letter[order]
        parted = (letter[1:] != letter[:-1]) | (block[1:] != block[:-1])
        new = np.r_[True, parted][:len(row)]
        alone = new & np.r_[parted, True][:len(row)]
        row, block = row[~alone], np.cumsum(new)[~alone]
        if not len(row):
            break
    start = suffix[row]
    return owner[start], start - first[start]
