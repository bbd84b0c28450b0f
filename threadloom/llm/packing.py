"""Packing of token ids into sequences of bounded length, in the order of the documents.

The documents a task reads form one stream of ids. Windows are cut out of it by dynamic programming
over candidate places: ends of documents, ends of sentences, and, where neither comes for
``hard_step`` ids, places in between. A window costs its padding, and its end a penalty: none at the
end of a document, ``sentence_cut`` ids inside one, ``hard_cut`` inside a sentence. The best cost up
to place p is

    cost(p) = penalty(p) + window - p + min(cost(q) + q) over places q with p - window <= q < p,

a sliding minimum that a monotone queue keeps, since ``cost(q) + q`` does not depend on p. Lengths of
a power of two need no padding; those few transitions are looked at by themselves.

No row is shuffled. A task works through its rows in stretches of about ``stretch`` ids; what the
last cut of a stretch leaves goes to the next one, so only a task's last window ends where it must.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ship
from threadloom.storage import materialize

SLICE_BYTES = 4 << 20  # text that is turned into ids at once
CACHE_BYTES = 96 << 20  # of words whose ids are known, before the cache starts anew
SENTENCE_ENDS = ".!?…。！？"
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of whole texts. No id spans a blank or a line end in this kind of vocabulary (white space
    is dropped), so the words between them are encoded once each, by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.word_end = self.ends.copy()
        for token, number in vocabulary.items():
            self.word_end[number] = token.endswith("</w>")
            self.ends[number] = token.removesuffix("</w>").endswith(tuple(SENTENCE_ENDS))
        self._forget()

    def _forget(self):
        self.known, self.bytes, self.used = {}, 0, 0
        self.ids = np.zeros(1 << 20, np.int32)
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, words: list[str]):
        """Words of letters alone go to the library many at a time, each ending with the one id of a
        word's end it has; should their number differ, and for all other words, one by one."""
        plain = [w for w in words if w.isalpha()]
        order, ids, count = [], [], []
        parts = [plain[at:at + 512] for at in range(0, len(plain), 512)]
        for some, found in zip(parts, self.library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            found = np.array(found.ids, np.int32)
            last = np.flatnonzero(self.word_end[found])
            if len(last) == len(some) and last[-1] == len(found) - 1:
                order += some
                ids.append(found)
                count.append(np.diff(np.r_[-1, last]))
        rest = set(words).difference(order)
        rest = [w for w in words if w in rest]
        found = [e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False)]
        order += rest
        ids = np.concatenate([*ids, np.array([i for e in found for i in e], np.int32)])
        count = np.concatenate([*count, np.array([len(e) for e in found], np.int64)])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.int32)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))
        self.first = np.r_[self.first, (self.used + np.cumsum(count) - count).astype(np.int32)]
        self.count = np.r_[self.count, count.astype(np.int32)]
        self.used += len(ids)
        self.bytes += sum(map(len, order)) + 4 * len(ids) + 150 * len(order)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        # ASCII capitals may be folded first unless a combining mark could join one of them. A mark
        # that ends a word never joins its letters, so the two may be apart.
        texts = pc.if_else(pc.match_substring_regex(texts, r"\p{M}"), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring(texts.cast(pa.large_string()), "\n", " ")
        words = pc.split_pattern(pc.replace_substring_regex(texts, r"([a-z])([.,;:!?])( |$)", r"\1 \2\3"), " ")
        per_text = np.diff(words.offsets.to_numpy())
        different = pc.dictionary_encode(words.flatten())
        names = different.dictionary.to_pylist()
        if self.bytes > CACHE_BYTES:
            self._forget()
        self._learn([w for w in names if w not in self.known])
        place = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        code = different.indices.to_numpy()
        first, n = self.first[place][code], self.count[place][code]
        ends = np.cumsum(n, dtype=np.int64)
        # From one id to the next is one step in the store, but for the first id of a word.
        some = n > 0
        step = np.ones(int(ends[-1]) if len(ends) else 0, np.int32)
        begins = first[some]
        step[(ends - n)[some]] = begins - np.r_[np.int32(0), (begins + n[some] - 1)[:-1]]
        ids = self.ids[np.cumsum(step, dtype=np.int32)]
        upto = np.r_[0, ends][np.r_[0, np.cumsum(per_text)]]
        return ids, np.diff(upto)


@dataclass(frozen=True)
class Costs:
    window: int
    sentence_cut: int
    hard_cut: int
    hard_step: int


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties): rising places where a window may end, from 0 to the stream's end."""
    soft = np.unique(np.r_[0, doc_ends, sentence_ends])
    gap = np.diff(soft)
    extra = (gap - 1) // costs.hard_step
    # Inside a wide gap one place every hard_step ids.
    step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    hard = np.repeat(soft[:-1], extra) + step * costs.hard_step
    at = np.r_[soft, hard]
    penalty = np.r_[np.where(np.isin(soft, doc_ends), 0, costs.sentence_cut), np.full(len(hard), costs.hard_cut)]
    order = np.argsort(at, kind="stable")
    penalty = penalty[order]
    penalty[0] = 0
    return at[order], penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int, last: bool) -> list[int]:
    """Ends of the windows of least cost, as rising places of ``at``.

    The last window ends at the end of the stream if it is the ``last`` one; else at whichever place
    of the last ``window`` ids is reached at least cost.
    """
    places, penalties = at.tolist(), penalty.tolist()
    # Places from which a power of two leads here: no padding.
    to, source = [], []
    for power in range(window.bit_length() - 1):
        back = np.searchsorted(at, at - (1 << power))
        hit = np.flatnonzero(at[back] == at - (1 << power))
        to.append(hit)
        source.append(back[hit])
    to, source = np.concatenate([*to, [len(at)]]), np.concatenate([*source, [0]])
    order = np.argsort(to, kind="stable")
    to, source = to[order].tolist(), source[order].tolist()
    cost, before = [0] * len(places), [0] * len(places)
    queue = deque([0])  # places with rising cost + place
    level = deque([0])
    e = 0
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0]] < p - window:
            queue.popleft()
            level.popleft()
        best, by = level[0] + window - p, queue[0]
        while to[e] == j:
            if cost[source[e]] < best:
                best, by = cost[source[e]], source[e]
            e += 1
        best += penalties[j]
        cost[j], before[j] = best, by
        while level and level[-1] >= best + p:
            queue.pop()
            level.pop()
        queue.append(j)
        level.append(best + p)
    j = len(places) - 1
    if not last:
        near = range(int(np.searchsorted(at, at[-1] - window, "right")), len(places))
        j = min(near, key=lambda i: (cost[i], -i))
    cuts = []
    while j > 0:
        cuts.append(places[j])
        j = before[j]
    return cuts[::-1]


def _final_parts(start: int, end: int, costs: Costs) -> list[int]:
    """Ends of the parts of a task's last window: powers of two where that costs less than padding."""
    size = end - start
    parts = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
    if costs.window - size <= costs.hard_cut * (len(parts) - 1):
        return [end]
    return (start + np.cumsum(parts)).tolist()


class Stream:
    """The documents of one task, of which windows have been cut so far."""

    def __init__(self, costs: Costs, sentence_end: np.ndarray, first_sequence: int):
        self.costs, self.sentence_end, self.sequence = costs, sentence_end, first_sequence
        self.rows, self.ids, self.sizes, self.done = [], [], [], 0

    def add(self, rows: list, ids: np.ndarray, sizes: np.ndarray):
        self.rows += rows
        self.ids.append(ids)
        self.sizes += sizes.tolist()

    def held(self) -> int:
        return sum(map(len, self.ids))

    def cut(self, last: bool):
        """(rows of pieces, ids) of the windows that can be closed. ``done`` ids of the first document
        were closed before and are not held any more."""
        ids = np.concatenate(self.ids)
        size = np.array(self.sizes, np.int64)
        ends = np.cumsum(size) - self.done
        begins = ends - size  # the first may be negative
        at, penalty = candidates(ends, np.flatnonzero(self.sentence_end[ids]) + 1, self.costs)
        cuts = best_cuts(at, penalty, self.costs.window, last)
        if last and cuts:
            begin = cuts[-2] if len(cuts) > 1 else 0
            cuts[-1:] = _final_parts(begin, cuts[-1], self.costs)
        closed = cuts[-1] if cuts else 0
        starts = np.unique(np.r_[0, ends[ends < closed], cuts[:-1]]).astype(np.int64)
        stops = np.r_[starts[1:], closed]
        doc = np.searchsorted(ends, starts, "right")
        window = np.searchsorted(cuts, starts, "right")
        base = np.r_[0, cuts][window]
        pieces = [(self.rows[d], a - begins[d], b - a, size[d], self.sequence + w, a - f)
                  for a, b, d, w, f in zip(*(x.tolist() for x in (starts, stops, doc, window, base)))]
        self.sequence += len(cuts)
        kept = int(np.searchsorted(ends, closed, "right"))
        held = [ids[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        self.done = int(closed - begins[kept]) if kept < len(size) else 0
        self.rows, self.sizes, self.ids = self.rows[kept:], self.sizes[kept:], [ids[closed:]]
        return pieces, held


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, sentence_cut: int = 4, hard_cut: int = 32,
         hard_step: int = 128, stretch: int = 2_000_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of a document.

    A document's ids are its text's and ``end_id``. Each id lies in one piece; the pieces of a
    sequence follow each other without a gap, and those of a document follow each other in rising
    sequences. Sequence ids are unique, not dense. With ``with_ids`` the pieces carry their ``ids``.

    Null and empty texts are documents of the end id alone. Rows without an id, and repeated rows, are
    documents like any others. Texts of any length are cut into as many windows as they need. An empty
    table gives no pieces. Other columns are not read. The result is written once, since windows
    depend on how the rows are spread over tasks.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    ship(spark)
    costs = Costs(window, sentence_cut, hard_cut, min(hard_step, window))
    spark.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {PIECE}" + (", ids array<int>" if with_ids else "")

    def run(batches):
        import os

        from pyspark import SparkFiles

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = None

        def closed(stream, last):
            pieces, ids = stream.cut(last)
            columns = list(zip(*pieces)) if pieces else [[]] * 6
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            values = [pa.array(columns[0], id_type), *[pa.array(columns[c], pa.int64()) for c in (1, 2)], pa.array(crc, pa.int64()),
                      *[pa.array(columns[c], pa.int64()) for c in (3, 4, 5)]]
            names = [id_col, *[c.split()[0] for c in PIECE.split(", ")]]
            if with_ids:
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                values.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(values, names)

        for batch in batches:
            if encoder is None:
                encoder = WordIds(SparkFiles.get(name))
                ends = np.r_[encoder.ends, np.zeros(max(0, end_id + 1 - len(encoder.ends)), bool)]
                stream = Stream(costs, ends, TaskContext.get().partitionId() << 33)
                id_type = batch.schema.field(0).type
            texts = batch.column(1)
            size = np.asarray(pc.binary_length(texts)).astype(np.int64)
            share = np.cumsum(size) // SLICE_BYTES
            for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(share)) + 1):
                if not len(part):
                    continue
                ids, counts = encoder.encode(texts.slice(part[0], len(part)))
                after = np.cumsum(counts)
                ids = np.insert(ids, after, end_id)
                stream.add(batch.column(0).slice(part[0], len(part)).to_pylist(), ids, counts + 1)
                if stream.held() >= stretch:
                    yield closed(stream, False)
        if encoder is not None and stream.held():
            yield closed(stream, True)

    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(run, schema), "pieces")
