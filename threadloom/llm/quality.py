"""Document quality by regularised quadratic discriminant analysis.

Each text gives transformed statistics. Class means and covariances come from sums over all
labelled rows; covariances shrink towards the pooled one and towards its diagonal. A score is the
difference of the two Mahalanobis log densities, from Cholesky factors computed once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ship
from threadloom.storage import materialize

_KEEP_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*+<=>@[]^_{|}~/\\"
_MARKS = b"!?"
_ENDS = b".,;:"
NAMES = ("length", "word_length", "upper", "digit", "symbol", "mark", "end", "repeat", "variety", "common",
         "bars", "marked", "line_repeat")


def _squash(share: float) -> float:
    """Spreads small shares apart."""
    return float(np.log(0.005 + share))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; null counts as empty."""
    data = (text or "").encode()
    n = len(data) or 1
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / n
    words = data.split()
    m = len(words) or 1
    lines = [x for x in data.split(b"\n") if x]
    counts = Counter(words)
    return [
        float(np.log1p(len(words))), (len(data) - len(words)) / m if words else 0.0,
        _squash(share(_KEEP_UPPER)), _squash(share(_DIGITS)), _squash(share(_SYMBOLS)), _squash(share(_MARKS)), _squash(share(_ENDS)),
        _squash(sum(map(eq, words, words[1:])) / m), len(counts) / m, _squash(max(counts.values(), default=0) / m),
        _squash(counts[b"|"] / m), _squash(len(re.findall(rb"[!-+/<-@[-`{-~](?:\s|$)", data)) / m),
        _squash(1 - len(set(lines)) / len(lines) if lines else 0.0)]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, x array<double>) of every row."""
    ship(docs.sparkSession)
    names = [id_col, *keep]

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    rows = docs.select(*names, F.col(text_col).alias("_text_"))
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{schema}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Log prior odds, and per class the mean, inverse Cholesky factor and log determinant."""

    prior: float
    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from 0 to 1."""
        if not len(x):
            return np.zeros(0)
        z = np.einsum("kij,knj->kni", self.whiten, x[None] - self.means[:, None])
        density = -0.5 * (z * z).sum(2) - 0.5 * self.log_det[:, None]
        gap = np.clip(self.prior + density[1] - density[0], -500, 500)
        return 1 / (1 + np.exp(-gap))


def fit(rows: DataFrame, shrink: float = 0.1, floor: float = 0.01) -> Discriminant:
    """From rows (x, y) with y 0 or 1: class sums are added up in Spark, in columns of one row a class.

    A class without rows has the pooled moments; no rows at all score 0.5 times the prior.
    """
    d = len(NAMES)
    x = lambda i: F.element_at("x", i + 1)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy("y").agg(F.count("*"), F.array(*[F.sum(x(i)) for i in range(d)]),
                                 F.array(*[F.sum(x(i) * x(j)) for i, j in pairs])).collect()  # two rows
    n, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for y, count, s, q in sums:
        n[y], first[y] = count, s
        for (i, j), v in zip(pairs, q):
            second[y, i, j] = second[y, j, i] = v
    all_n = max(n.sum(), 1)
    mean = first.sum(0) / all_n
    pooled = second.sum(0) / all_n - np.outer(mean, mean)
    means, whiten, log_det = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        means[k] = first[k] / n[k] if n[k] else mean
        own = second[k] / n[k] - np.outer(means[k], means[k]) if n[k] else pooled
        mixed = (1 - shrink) * own + shrink * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled)))
        factor = np.linalg.cholesky(mixed + floor * np.eye(d))
        whiten[k], log_det[k] = np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()
    return Discriminant(float(np.log((n[1] + 1) / (n[0] + 1))), means, whiten, log_det)


def remainder(id_col: str, mod: int):
    """crc32 of an id's text modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def labelled(labels: DataFrame, target: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y) where all labels of an id agree on 0 or 1; ids repeated with both are left out."""
    y = F.col(target).cast("int")
    return (labels.filter(F.col(id_col).isNotNull() & y.isin(0, 1)).groupBy(F.col(id_col).alias("_id_"))
            .agg(F.min(y).alias("y"), F.max(y).alias("_most_")).filter("y = _most_").drop("_most_"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held: int = 2,
                  id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, held_out, score, predicted) of every row, ``keep`` being columns to carry.

    Rows whose crc32(id) modulo ``folds`` is ``held`` are never learnt from. A null id is not held
    out and has no label. Null texts count as empty; empty texts are scored like any other.
    Repeated rows get equal scores and count in the fit as often as they stand. Without labels of
    both classes scores tell nothing, but are defined. Other columns are not read.
    """
    rows = materialize(with_statistics(docs, id_col, text_col, keep), "statistics")
    out = F.coalesce(remainder(id_col, folds) == held, F.lit(False))
    score = scorer(fit_labelled(rows, labels, folds, held, id_col))
    return (rows.select(id_col, *keep, out.alias("held_out"), score("x").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def fit_labelled(rows: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id") -> Discriminant:
    """From rows (id_col, x) and labels, less the held-out ids."""
    out = F.coalesce(remainder(id_col, folds) == held, F.lit(False))
    return fit(rows.filter(~out).join(labelled(labels, "quality", id_col), F.col(id_col) == F.col("_id_")).select("x", "y"))


def scorer(model: Discriminant):
    """Column function from ``x`` to the score."""
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(x.tolist(), float).reshape(len(x), -1)))

    return score
