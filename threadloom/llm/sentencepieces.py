"""SentencePiece encoding and decoding for merge-type vocabularies.

Symbols of a unit are merged by a score-ordered agenda of adjacent pairs: best score first, the
leftmost of equal ones. No piece of a supported vocabulary runs from other text into a space mark,
so a text is encoded unit by unit (its space marks and what follows them), and each different unit
of a batch is encoded once. Short units share one agenda matrix, a row each, and every row takes
its best pair in each round; long units have a heap. Units and whole texts of every Arrow batch are
checked against the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
import struct
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ship

SPACE = "▁"
CACHED_BYTES = 48 << 20  # of known units, in two generations of half of it
UNIT_BYTES = 200  # of a known unit's Python objects, beside its characters and ids
CHECKED_CHARS = 20_000  # of units checked in one go, and of the text of a slice checked whole
SHORT_UNIT = 64
SLICE_BYTES = 2 << 20
# Fixed values of the model file format.
NORMAL, UNKNOWN, BYTE, MERGE_MODEL = 1, 2, 6, 2


def _fields(data: bytes):
    """(number, value) of a serialized message, one level deep."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


class MergeModel:
    """A merge vocabulary with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[str | int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
                index = len(self.surface)
                if kind == NORMAL:
                    self.pieces[text] = (index, score)
                elif kind == BYTE:
                    self.bytes[int(text[3:5], 16)] = index
                elif kind in (4, 5):
                    raise ValueError("user-defined and unused pieces are not supported")
                self.surface.append(int(text[3:5], 16) if kind == BYTE else text if kind == NORMAL else "")
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        supported = (trainer.get(3) == MERGE_MODEL and not trainer.get(24) and len(self.bytes) == 256
                     and not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1)
                     and normalizer.get(5, 1) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces))
        if not supported:
            raise ValueError("not a merge vocabulary with byte fallback and identity normalisation")
        self._tabulate()
        self.shown = np.array([bytes([s]) if isinstance(s, int) else s.replace(SPACE, " ").encode() for s in self.surface], object)
        self.old: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.held = 0

    def _tabulate(self) -> None:
        """Sorted (left id, right id) pairs with the rank and id of the piece they make."""
        order = {s: i for i, s in enumerate(sorted({s for _, s in self.pieces.values()}, reverse=True))}
        made = sorted((a << 32 | b, order[score], index) for text, (index, score) in self.pieces.items()
                      for cut in range(1, len(text))
                      if (a := self.pieces.get(text[:cut], (-1,))[0]) >= 0
                      and (b := self.pieces.get(text[cut:], (-1,))[0]) >= 0)
        self.pair, self.rank, self.made = np.array([*made, (2**62, 0, 0)], np.int64).T.copy()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table, -1 for those that make no piece."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pair, key)  # the last pair is larger than any
        return np.where((left >= 0) & (right >= 0) & (self.pair[at] == key), at, -1)

    def merge_short(self, units: list[str]) -> list[bytes]:
        """Ids, as int32 bytes, of units of one length, merged together.

        Rows are units, columns characters; the last column stands for what is beyond both ends."""
        size, n = len(units[0]), len(units)
        chars = np.array(units).view(np.uint32).reshape(n, size)
        known, at = np.unique(chars, return_inverse=True)
        # Characters that are no piece have negative symbols and take no part in pairs.
        first = np.array([self.pieces.get(chr(c), (-1 - int(c),))[0] for c in known], np.int32)
        symbols = np.full((n, size + 1), -1, np.int32)
        symbols[:, :size] = first[at.reshape(n, size)]
        after = np.tile(np.arange(1, size + 2, dtype=np.int16), (n, 1))
        before = np.tile(np.r_[size, np.arange(size)].astype(np.int16), (n, 1))
        none = len(self.pair)
        agenda, makes = np.full((n, size + 1), none, np.int32), np.zeros((n, size + 1), np.int32)

        def offer(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            hit = self._pairs(symbols[row, left], symbols[row, right])
            agenda[row, left], makes[row, left] = np.where(hit < 0, none, self.rank[hit]), self.made[hit]

        for column in range(size - 1):
            offer(np.arange(n), np.full(n, column), np.full(n, column + 1))
        alive = np.ones((n, size), bool)
        live = np.arange(n)
        while live.size:
            own = agenda[live]
            best = own.argmin(1)
            able = own[np.arange(len(live)), best] < none
            live, best = live[able], best[able]
            gone = after[live, best]
            right, left = after[live, gone], before[live, best]
            symbols[live, best] = makes[live, best]
            alive[live, gone] = False
            agenda[live, gone] = none
            after[live, best], before[live, right] = right, best
            offer(live, best, right)
            offer(live, left, best)
        flat = symbols[:, :size][alive]
        data, ends = flat.tobytes(), (4 * np.cumsum(alive.sum(1))).tolist()
        out = [data[i:j] for i, j in zip([0, *ends], ends)]
        for i in np.flatnonzero((symbols[:, :size] < 0).any(1) & ((symbols[:, :size] < 0) & alive).any(1)):
            ids = [x for s in symbols[i, :size][alive[i]].tolist()
                   for x in ([s] if s >= 0 else [self.bytes[b] for b in chr(-1 - s).encode()])]
            out[i] = _packed(ids)
        return out

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit of any length."""
        pieces, symbols = self.pieces, list(unit)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (found := pieces.get(joined := symbols[left] + symbols[right])):
                heapq.heappush(agenda, (-found[1], left, right, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if after[left] != right or not symbols[left] or symbols[left] + symbols[right] != joined:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        ids: list[int] = []
        for s in filter(None, symbols):
            found = pieces.get(s)
            ids += [found[0]] if found else [self.bytes[b] for b in s.encode()]
        return ids

    def surface_of(self, ids: list[int]) -> str:
        """Text of ids; bytes that do not form characters become U+FFFD, one each."""
        try:
            return "".join([self.surface[i] for i in ids]).replace(SPACE, " ")
        except TypeError:  # a byte among them
            out, run = [], bytearray()
        for i in ids:
            if isinstance(piece := self.surface[i], int):
                run.append(piece)
                continue
            out += [_decode_bytes(run), piece]
            run = bytearray()
        return "".join([*out, _decode_bytes(run)]).replace(SPACE, " ")

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int32)
        if not ids.size:
            return ""
        try:  # pieces are whole characters, so this is text just where every run of bytes is
            text = b"".join(self.shown[ids].tolist()).decode()
        except UnicodeDecodeError:
            text = self.surface_of(ids.tolist())
        first = self.surface[ids[0]]
        return text[1:] if isinstance(first, str) and first.startswith(SPACE) else text

    def _learn(self, units: set[str]) -> None:
        units = sorted(units, key=len)
        found: list[bytes] = []
        for size, group in groupby(units, key=len):
            group = list(group)
            for at in range(0, len(group), 50_000):
                part = group[at:at + 50_000]
                found += self.merge_short(part) if size <= SHORT_UNIT else [_packed(self.merge(u)) for u in part]
        self._check(units, found)
        self.new.update(zip(units, found))
        self.held += sum(map(len, units)) + sum(map(len, found)) + UNIT_BYTES * len(units)

    def _check(self, units: list[str], found: list[bytes]) -> None:
        """All of these against the library. Units that end in a character follow each other in one
        text, of which the library adds the first space itself; blank ones stand alone."""
        run, ids, size = [], [], 0
        for unit, packed in zip(units, found):
            if unit[-1] == SPACE:
                if unit != SPACE:
                    self._compare([unit], [packed])
                continue
            run.append(unit)
            ids.append(packed)
            size += len(unit)
            if size >= CHECKED_CHARS:
                self._compare(run, ids)
                run, ids, size = [], [], 0
        if run:
            self._compare(run, ids)

    def _compare(self, units: list[str], found: list[bytes]) -> None:
        text = "".join(units).replace(SPACE, " ")[1:]
        theirs = self.library.encode(text, num_threads=1)
        if _packed(theirs) != b"".join(found) or self.library.decode(theirs) != text:
            raise RuntimeError(f"differs from the library on {text[:80]!r}")

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """(ids as int32 bytes, decoded text) of each text."""
        split = [re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        asked = set().union(*split)
        missing = asked - self.new.keys()
        again = {u: self.old[u] for u in missing & self.old.keys()}
        self.new.update(again)
        self.held += sum(map(len, again)) + sum(map(len, again.values())) + UNIT_BYTES * len(again)
        if missing := missing - self.old.keys():
            self._learn(missing)
        known = self.new.__getitem__
        encoded = [b"".join(map(known, units)) for units in split]
        decoded = [self.decode(np.frombuffer(ids, "<i4")) for ids in encoded]
        for i in [i for i, t in enumerate(texts) if len(t) <= CHECKED_CHARS][:1]:
            theirs = self.library.encode(texts[i])
            if _packed(theirs) != encoded[i] or self.library.decode(theirs) != decoded[i]:
                raise RuntimeError(f"differs from the library on {texts[i][:80]!r}")
        if self.held > CACHED_BYTES // 2:
            self.old, self.new, self.held = self.new, {}, 0
        return encoded, decoded


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def _decode_bytes(run: bytearray) -> str:
    return "".join("�" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in run.decode("utf-8", "surrogateescape"))


_models: dict[bytes, MergeModel] = {}


def _model(data: bytes) -> MergeModel:
    """One model per worker process, so that units stay known from task to task."""
    return _models.setdefault(data, None) or _models.__setitem__(data, MergeModel(data)) or _models[data]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded string) of every row, in whole texts.

    Null and empty texts have no ids and an empty decoded text. Rows, ids and repeats stay as they
    are; other columns are not read. The vocabulary (of a fixed size) is read on the driver once.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(batches):
        model = _model(data.value)
        for whole in batches:
            step = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                encoded, decoded = model.encode_batch([t or "" for t in batch.column(1).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())],
                                                 ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col))
