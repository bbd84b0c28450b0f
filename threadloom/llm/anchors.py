"""Content-chosen places in texts that stand for all windows of ``window`` bytes.

Every window has an anchor: the start of the smallest hash among its ``core``-byte strings, the
last one if several are equal. Equal windows have equal cores, at the same distance from their
starts, so windows need comparing only where their cores are equal. Starts with one anchor are
consecutive; a run of them is one row, which keeps the rows at about two per ``window - core``.

The rolling hash chooses anchors and brings cores that may be equal together; equal bytes always have
equal hashes. That bytes are equal is decided by 128-bit digests of the bytes themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Odd multipliers and a letter table, fixed so that hashes agree across tasks.
_B = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LETTERS = np.random.default_rng(20_240_229).integers(1, 2**63, (2, 256), dtype=np.uint64)
_PLACE = 28  # bits of a packed value that hold the place
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2**64, from 0 to ``n``."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = max(n + 1, 1 << 20)
        found = []
        for base in (_B[which], pow(_B[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            found.append(np.cumprod(p, dtype=np.uint64))
        _powers[which] = tuple(found)
    up, down = _powers[which]
    return up[:n + 1], down[:n + 1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of substrings of one buffer."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _power(which, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[which][data] * up[:-1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)
    rows = np.concatenate([x, pad]).reshape(-1, width)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


DIGEST = 16


def digests(data: bytes | memoryview, start: np.ndarray, end: np.ndarray, mark: np.ndarray) -> bytes:
    """A digest of each substring and of a number of its own, one after another."""
    data = memoryview(data)
    new = hashlib.blake2b
    return b"".join([new(data[a:b], digest_size=DIGEST, salt=m.to_bytes(8, "little")).digest()
                     for a, b, m in zip(start.tolist(), end.tolist(), mark.tolist())])


def pairs(found: bytes) -> np.ndarray:
    """Digests as rows of two numbers."""
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def anchors(texts: list[bytes], window: int, core: int):
    """(text, place, first start, last start, core hash, class digests) of every anchor.

    The class digest is of all bytes the run's windows cover and of where the anchor is in them.
    """
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data) or size.max() < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, b""
    if len(data) >= 1 << _PLACE:
        return _in_parts(texts, window, core)
    end = np.repeat(ends, size)
    first = Hashes(data, 0)
    at = np.arange(len(data) - core + 1)
    value = first.of(at, at + core)
    low = np.uint64((1 << _PLACE) - 1)
    packed = (value & ~low) | (low - at.astype(np.uint64))
    least = sliding_min(packed, window - core + 1)
    start = np.flatnonzero(np.arange(len(least)) + window <= end[:len(least)])
    place = (low - (least[start] & low)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    lo, hi, place = start[new], start[np.r_[new[1:], len(start)] - 1], place[new]
    kind = digests(data.data, lo, hi + window, place - lo)
    text = np.searchsorted(ends, lo, "right")
    base = ends[text] - size[text]
    return text, place - base, lo - base, hi - base, value[place].view(np.int64), kind


def _in_parts(texts: list[bytes], window: int, core: int):
    """The same for texts too long for packed places: parts that overlap by a window less one. A run
    that a cut parts becomes two, which changes nothing in what repeats."""
    step = (1 << _PLACE) - (1 << 20)
    found = []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - window + 1), step):
            _, place, lo, hi, value, kind = anchors([t[at:at + step + window - 1]], window, core)
            found.append((np.full(len(place), i), place + at, lo + at, hi + at, value, kind))
    return (*(np.concatenate([f[c] for f in found]) for c in range(5)), b"".join(f[5] for f in found))
