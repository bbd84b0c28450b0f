"""Whitening of vectors by principal components.

Entries become whole numbers, so the covariance is exact: tasks centre their vectors on the rounded
mean and sum products of whole numbers, and what the rounding leaves is taken off in whole numbers.
Only this matrix, of vector length squared, comes to the driver. Its eigenvectors start as float32
ones and are corrected by the iteration of Ogita and Aishima, which is matrix products alone, in
extended precision. Where eigenvalues lie so close together that the iteration cannot tell their
vectors apart, a small problem on the space they span, with the common part of the eigenvalues taken
off, gives a new start.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ship
from threadloom.storage import materialize

LIMIT = 1 << 40  # whole entries stay below this


def off(x: np.ndarray) -> np.ndarray:
    return x - np.diag(np.diag(x))


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so, by two quadratic steps."""
    for _ in range(2):
        x = x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    return x


def correction(v: np.ndarray, x: np.ndarray):
    """One step of the iteration: (change of x, its values, clusters whose vectors it cannot part).

    Vectors with values closer than the present error are only made orthonormal."""
    gram = np.eye(len(v), dtype=v.dtype) - x.T @ x
    form = x.T @ v @ x
    value = np.diag(form) / (1 - np.diag(gram))
    error = 2 * (np.linalg.norm(off(form).astype(float)) + np.linalg.norm(v.astype(float)) * np.linalg.norm(gram.astype(float)))
    gap = value[None, :] - value[:, None]
    near = np.abs(gap) <= error
    with np.errstate(divide="ignore", invalid="ignore"):
        change = np.where(near, gram / 2, (form + value[None, :] * gram) / gap)
    order = np.argsort(value)
    clusters = [c for c in np.split(order, np.flatnonzero(np.diff(value[order]) > error) + 1) if len(c) > 1]
    return x @ change, value, clusters


def eigenvectors(v: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix of extended precision, values falling."""
    n = len(v)
    size = np.abs(v).max(initial=0)
    if size == 0:
        return np.zeros(n, v.dtype), np.eye(n, dtype=v.dtype)
    v = v / size
    x = np.linalg.eigh(v.astype(np.float32))[1].astype(v.dtype)
    tiny = np.finfo(v.dtype).eps * n
    best = np.inf
    for _ in range(rounds):
        change, _, clusters = correction(v, x)
        x = x + change
        for c in clusters:
            part = x[:, c]
            form = part.T @ v @ part
            middle = np.trace(form) / len(c)
            shifted = form - middle * np.eye(len(c), dtype=v.dtype)
            scale = np.abs(shifted).max()
            if scale > 0:
                x[:, c] = orthonormal(part @ np.linalg.eigh((shifted / scale).astype(float))[1].astype(v.dtype))
        done = np.abs(off(x.T @ v @ x)).max(initial=0) + np.abs(np.eye(n, dtype=v.dtype) - x.T @ x).max()
        if done <= tiny or (done < 1e-13 and done >= best / 2):
            break
        best = min(best, done)
    x = orthonormal(x)
    value = np.diag(x.T @ v @ x)
    order = np.argsort(-value, kind="stable")
    return value[order] * size, x[:, order]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python numbers, by float64 products as far as these are exact."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if top * top * len(y) < 1 << 63:
        return (y.T @ y).astype(object)
    high, low = y >> 20, y & ((1 << 20) - 1)
    cross = _exact_products(high + low) - _exact_products(high) - _exact_products(low)
    return (_exact_products(high) << 40) + (cross << 20) + _exact_products(low)


def _summed(fit: DataFrame, parts) -> dict[tuple[int, int], int]:
    """Sums over all tasks of what ``parts`` gives of a task's vectors: {(i, j): whole number}."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = parts(_matrix(batch.column(0)))
                total = found if total is None else total + found
        if total is not None:
            i, j = np.nonzero(total != 0)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(x) for x in total[i, j]], pa.string())], ["i", "j", "x"])

    # One row an entry, however many tasks there are.
    found = fit.mapInArrow(run, "i int, j int, x string").groupBy("i", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return {(r.i, r.j): int(r.x) for r in found.collect()}


def _fit(fit: DataFrame, n: int, dim: int, count: int):
    """(sums, values, vectors, trace) of the fit list."""
    sums = _summed(fit, lambda x: x.astype(object).sum(0, keepdims=True))
    sums = [sums.get((0, j), 0) for j in range(dim)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    products = _summed(fit, lambda x: _exact_products(x - centre))
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    v = np.empty((dim, dim), np.longdouble)
    trace = Fraction(0)
    for i in range(dim):
        for j in range(i, dim):
            exact = Fraction(n * products.get((i, j), 0) - rest[i] * rest[j], n * n)
            high = float(exact)
            v[i, j] = v[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
        trace += exact if dim == i + 1 else Fraction(n * products.get((i, i), 0) - rest[i] ** 2, n * n)
    value, vector = eigenvectors(v)
    # Values within the rounding of the matrix are those of directions without variance.
    value = np.where(value > np.finfo(float).eps * dim * float(trace), value, 0)
    return sums, value[:count].astype(float), vector[:, :count], float(trace)


def _whitened(x: np.ndarray, n: int, sums: list[int], value: np.ndarray, vector: np.ndarray):
    """(exact deviation of each row or None, whitened rows; NaN where a value is zero)."""
    top = max([abs(s) for s in sums], default=0) + n * int(np.abs(x).max(initial=0))
    whole = np.int64 if top * top * max(1, x.shape[1]) < 1 << 63 else object
    z = x.astype(whole) * n - np.array(sums, whole)[None, :]
    deviation = [d if d < 1 << 63 else None for d in (z * z).sum(1).tolist()]
    centred = (z / n).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return deviation, np.where(value > 0, centred @ vector.astype(float) / np.sqrt(value), np.nan)


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error), one row a vector and
    component, as many as the vector is long but ``components`` at most.

    Entries become floor(scale * c) + offset. The fit list holds each different vector of whole numbers
    once, so copies and repeated rows weigh nothing; they are whitened like all others. Vectors that are
    null or hold null or non-finite entries take no part. Vectors of different lengths are fitted apart
    from each other; empty ones have no components and give no rows. A component without variance has
    ``whitened`` null and ``explained`` 0 (null if no component has variance) and is left out of
    ``identity_error``, which is null if none is left. ``deviation`` is null where it does not fit a
    long. Whole entries of 2**40 or more fail the job with a message. Rows without an id are kept. An
    empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: F.coalesce((c.cast("double") - c.cast("double")) == 0, F.lit(False)))

    def entry(c):
        c = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(c) < LIMIT, F.floor(c)).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long")) + F.lit(offset).cast("long")

    rows = vectors.filter(v.isNotNull()).filter(finite & (F.size(v) > 0)).select(id_col, F.transform(v, entry).alias("x"))
    rows = materialize(rows, "whole-vectors")
    fits = materialize(rows.select("x").distinct(), "fit-list")
    found = None
    for dim, n in sorted(map(tuple, fits.groupBy(F.size("x")).count().collect())):
        part = _whitened_rows(rows.filter(F.size("x") == dim), fits.filter(F.size("x") == dim), n, dim, min(components, dim), id_col, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], empty)
    return found


def _whitened_rows(rows: DataFrame, fit: DataFrame, n: int, dim: int, count: int, id_col: str, kind: str) -> DataFrame:
    sums, value, vector, trace = _fit(fit, n, dim, count)
    some = np.flatnonzero(value > 0)

    def moments(batches):
        # Sums of the whitened vectors and of their products: a row a task.
        first, second = np.zeros(len(some)), np.zeros((len(some), len(some)))
        for batch in batches:
            if batch.num_rows:
                y = _whitened(_matrix(batch.column(0)), n, sums, value, vector)[1][:, some]
                first += y.sum(0)
                second += y.T @ y
        i, j = np.indices(second.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.full(len(some), -1), i.ravel()], pa.int32()), pa.array(np.r_[np.arange(len(some)), j.ravel()], pa.int32()),
                                          pa.array(np.r_[first, second.ravel()])], ["i", "j", "x"])

    error = None
    if len(some):
        mean, product = np.zeros(len(some)), np.zeros((len(some), len(some)))
        for r in fit.mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
            if r.i < 0:
                mean[r.j] = r.x / n
            else:
                product[r.i, r.j] = r.x / n
        error = float(np.abs(product - np.outer(mean, mean) - np.eye(len(some))).max())
    explained = pa.array([float(e) / trace if trace else None for e in value], pa.float64())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            deviation, white = _whitened(_matrix(batch.column(1)), n, sums, value, vector)
            many = batch.num_rows
            at = pa.array(np.repeat(np.arange(many), count))
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), many)), pa.array(np.full(many * count, n, np.int64)),
                 pa.array(deviation, pa.int64()).take(at), pa.array(flat, mask=np.isnan(flat)), pa.concat_arrays([explained] * many),
                 pa.array([error] * (many * count), pa.float64())],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
