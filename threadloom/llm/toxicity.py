"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly.

A word is the mean of the vectors of its character n-grams (of its bytes, with word ends marked),
a window the mean of its different words (filled up to a window's size with words that say
nothing, so that no word is heard more than once), and a linear softmax tells the classes apart. So a
misspelling never seen shares most of its vectors with the word it comes from. Embeddings and
weights are learnt together in numpy from windows of a bounded sample of labelled texts, each also
with a random slip in every word. A text scores as its worst window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ship
from threadloom.llm.quality import labelled, remainder

GRAMS = (3, 4, 5)
BUCKETS = 1 << 16
WINDOW = 12
CACHED_WORDS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
# ASCII but letters and digits parts words; letters are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of each n-gram of each word."""
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words), dtype=np.int64), size)
    at, bucket = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for j in range(n):
            h = (h + data[j:len(h) + j].astype(np.uint64) + np.uint64(n)) * _MIX
            h ^= h >> np.uint64(29)
        inside = word[:len(h)] == word[n - 1:]
        at.append(word[:len(h)][inside])
        bucket.append((h[inside] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(at), np.concatenate(bucket)


def _slip(word: bytes, rng) -> bytes:
    """The word with one letter doubled, dropped, changed or swapped."""
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    if kind == 0:
        return word[:i] + word[i:i + 1] + word[i:]
    if kind == 1:
        return word[:i] + word[i + 1:]
    if kind == 2:
        return word[:i] + bytes([int(rng.choice(list(b"aeio013xz")))]) + word[i + 1:]
    return word[:i] + word[i + 1:i + 2] + word[i:i + 1] + word[i + 2:]


@dataclass(frozen=True)
class Bag:
    """What a bucket adds to the log odds of class 1, and the bias: embedding times weights."""

    odds: np.ndarray
    bias: float

    def word_odds(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        at, bucket = grams(words)
        return np.bincount(at, self.odds[bucket], len(words)) / np.maximum(np.bincount(at, minlength=len(words)), 1)


class _Windows:
    """Words of texts cut into windows, for training."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.place, self.window, self.owner = [], [], []

    def add(self, words: list[bytes], owner: int) -> None:
        for at in range(0, len(words), WINDOW):
            own = dict.fromkeys(words[at:at + WINDOW])
            self.place += [self.known.setdefault(w, len(self.known)) for w in own]
            self.window += [len(self.owner)] * len(own)
            self.owner.append(owner)

    def windows(self) -> list[list[bytes]]:
        out = [[] for _ in self.owner]
        words = list(self.known)
        for p, w in zip(self.place, self.window):
            out[w].append(words[p])
        return out


def _sums(values: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(to, c, n) for c in values.T], 1)


def _descend(seen: _Windows, y: np.ndarray, params: list, epochs: int, rate: float, decay: float, min_texts: int):
    """Full-batch Adam on the weighted log loss; classes weigh the same. Buckets that fewer than
    ``min_texts`` of the texts have stay as they are. Gives the log odds of the windows as well."""
    place, window, owner = (np.array(v) for v in (seen.place, seen.window, seen.owner))
    label, n_words, n = y[owner], len(seen.known), len(owner)
    at, bucket = grams(list(seen.known))
    in_word = np.bincount(at, minlength=n_words)[:, None]
    texts_of = np.unique(owner[window] * n_words + place)
    word_texts = np.bincount(texts_of % n_words, minlength=n_words)
    support = np.bincount(bucket, word_texts[at], BUCKETS)
    able = support[bucket] >= min_texts
    used, bucket = np.unique(bucket[able], return_inverse=True)
    at = at[able]
    table, parts = params[0], [params[0][used], params[1], params[2]]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    weight = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    truth = np.eye(2)[label]
    for epoch in range(1, epochs + 1):
        own, weights, bias = parts
        x = _sums((_sums(own[bucket], at, n_words) / in_word)[place], window, n) / WINDOW
        z = x @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - truth) * weight[:, None]
        to_word = _sums(((error @ weights.T) / WINDOW)[window], place, n_words) / in_word
        for i, g in enumerate((_sums(to_word[at], bucket, len(used)), x.T @ error, error.sum(0))):
            g = g + (decay * parts[i] if i == 0 else 0)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            parts[i] = parts[i] - rate * (m[i] / (1 - 0.9**epoch)) / (np.sqrt(v[i] / (1 - 0.99**epoch)) + 1e-12)
    table = table.copy()
    table[used] = parts[0]
    return [table, *parts[1:]], z[:, 1] - z[:, 0]


def train(texts: list[str | None], y: list[int], dim: int = 4, epochs: tuple[int, int] = (25, 120), rate: float = 0.12,
          decay: float = 3e-5, min_texts: int = 8, seed: int = 7) -> Bag:
    """Embeddings, weights and bias from texts and their labels.

    At first every window has the label of its text. Most words of a toxic text are like anyone's,
    so training goes on with its worst window alone against all windows of the other texts, and
    with a copy of the former and of as many of the latter that has a slip in every word.
    """
    rng = np.random.default_rng(seed)
    y = np.array(y, int)
    first = _Windows()
    for i, text in enumerate(texts):
        first.add(words_of(text), i)
    if len(set(y[first.owner].tolist())) < 2:
        return Bag(np.zeros(BUCKETS), 0.0)
    params = [rng.normal(0, 0.01, (BUCKETS, dim)), rng.normal(0, 1, (dim, 2)), np.zeros(2)]
    min_texts = max(1, min(min_texts, len(texts) // 20))
    params, odds = _descend(first, y, params, epochs[0], rate, decay, min_texts)
    owner, windows = np.array(first.owner), first.windows()
    worst = np.full(len(y), -np.inf)
    np.maximum.at(worst, owner, odds)
    toxic = np.flatnonzero((y[owner] == 1) & (odds >= worst[owner]))
    plain = np.flatnonzero(y[owner] == 0)
    second = _Windows()
    for i in [*toxic, *plain]:
        second.add(windows[i], owner[i])
    for i in [*toxic, *plain[rng.permutation(len(plain))[:len(toxic)]]]:
        second.add([_slip(w, rng) for w in windows[i]], owner[i])
    (table, weights, bias), _ = _descend(second, y, params, epochs[1], rate, decay, min_texts)
    return Bag(table @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts with the odds of words seen kept from text to text."""

    def __init__(self, bag: Bag):
        self.bag, self.known = bag, {}

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [words_of(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        new = list(set().union(*split) - self.known.keys())
        self.known.update(zip(new, self.bag.word_odds(new).tolist()))
        return [self._score(words) for words in split]

    def _score(self, words: list[bytes]) -> float:
        # Windows half a window apart, so that what a border parts meets in another.
        odds = self.known.__getitem__
        sums = (sum(map(odds, set(words[at:at + WINDOW]))) for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2))
        worst = max(sums) / WINDOW
        return float(1 / (1 + np.exp(-np.clip(worst + self.bag.bias, -500, 500))))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1,
                   sample_rows: int = 800, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row, in whole texts.

    Trains on at most ``sample_rows`` labelled texts of each class, those with the smallest hash of
    the id, whose crc32(id) modulo ``folds`` is not ``held``. A null id is not held out and has no
    label. Null and empty texts have no windows and score as the bias alone. Repeated rows get
    equal scores. Without labels of both classes every score is 0.5. Other columns are not read.
    """
    ship(docs.sparkSession)
    out = F.coalesce(remainder(id_col, folds) == held, F.lit(False))
    marked = labelled(labels, "toxic", id_col)
    # Labels of texts that are not there take no place in the sample.
    marked = marked.join(docs.select(F.col(id_col).alias("_id_")), "_id_", "left_semi")
    chosen = None
    for mark in (0, 1):
        part = (marked.filter((F.col("y") == mark) & (remainder("_id_", folds) != held))
                .orderBy(F.xxhash64("_id_"), "_id_").limit(sample_rows))
        chosen = part if chosen is None else chosen.unionByName(part)
    # The chosen ids are at most twice sample_rows; a repeated document may come with each.
    sample = (docs.select(F.col(id_col).alias("_doc_"), F.col(text_col).alias("text"))
              .join(F.broadcast(chosen), F.col("_doc_") == F.col("_id_")).select("_id_", "text", "y")
              .dropDuplicates(["_id_", "text"]).orderBy(F.xxhash64("_id_"), "_id_", F.xxhash64("text")).limit(2 * sample_rows).collect())
    bag = train([r["text"] for r in sample], [r["y"] for r in sample])
    shared = docs.sparkSession.sparkContext.broadcast(bag)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            step = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = scorer.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
              .mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col))
    return scored.select(id_col, out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
