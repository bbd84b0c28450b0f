"""Exact top-k by inner product: every query scored against every row, term at a time.

A block of rows is held as postings, one list of (row, weight) per dimension. A query is a sparse
row; each of its terms scatters weight times posting into a dense array of scores, one slot per
row of the block. The best k of a block are cut out by partition selection, and blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import ship
from threadloom.storage import materialize


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id_col, v array<long>): floor(scale * x) of each component. Null vectors and those with
    null or non-finite components take no part, nor do rows without an id."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
            .select(F.col(id_col).alias(id_col), F.transform(v, lambda x: F.floor(F.lit(scale) * x)).alias("v")))


def _postings(matrix: np.ndarray):
    """Per dimension the rows with a weight and the weights; rows are None where all have one."""
    found = []
    for column in matrix.T:
        rows = np.flatnonzero(column)
        found.append((None, np.ascontiguousarray(column)) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return found


def block_top_k(query_ids, queries, row_ids, rows, k: int):
    """(query id, row id, score) of the best ``k`` rows of the block for each query."""
    # The narrowest type that holds every score; Python's integers where none does.
    most = max(1, rows.shape[1]) * int(abs(queries).max(initial=0)) * int(abs(rows).max(initial=0))
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    postings = _postings(rows.astype(kind))
    work = np.empty(len(rows), kind)
    for query_id, query in zip(query_ids, queries.astype(kind)):
        scores = np.zeros(len(rows), kind)
        for term in np.flatnonzero(query):
            at, weights = postings[term]
            if at is None:
                scores += np.multiply(weights, query[term], out=work)
            elif len(at):
                scores[at] += weights * query[term]
        able = np.flatnonzero(row_ids != query_id)
        if len(able) > k and kind is not object:
            bound = -np.partition(-scores[able], k - 1)[k - 1]
            able = able[scores[able] >= bound]
        best = able[np.lexsort((row_ids[able], -scores[able]))][:k]
        for i in best:
            yield query_id, row_ids[i], int(scores[i])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256, query_block: int = 2048, row_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k``
    rows with the highest integer inner product, its own id apart; ties go to the smaller id.

    Queries and rows are numbered once and cut into blocks of about the sizes given by a hash of the
    number, so rows of one id are spread like others; each block of queries meets each block of rows once, in a task that holds just these two. A block pair
    sends on ``k`` rows a query. Fewer than ``k`` others give fewer rows; repeated ids are scored
    as often as they stand. Different query vectors of one id have their rows ranked together; equal
    ones count once. Only vectors of one length can be compared: lengths of their own form worlds of their own. Scores beyond a long fail the job.
    """
    ship(vectors.sparkSession)
    rows = quantized(vectors, id_col, vector_col, scale).select(id_col, "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("_row_"))
    rows = materialize(rows, "whole-vectors")  # the numbers must not change any more
    queries = rows.filter(F.col(id_col) % every == 0).dropDuplicates([id_col, "v"])
    n_blocks, n_query_blocks = 1 + rows.count() // row_block, 1 + queries.count() // query_block
    place = lambda n: F.pmod(F.xxhash64("_row_"), F.lit(n)).cast("int")
    left = (rows.withColumn("rb", place(n_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
            .groupBy("dim", "rb", "qb"))
    right = (queries.withColumn("qb", place(n_query_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
             .groupBy("dim", "rb", "qb"))

    def matrix(t: pa.Table, dim: int):
        return (t.column(id_col).to_numpy(),
                t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))

    def score(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        found = list(block_top_k(*matrix(queries, dim), *matrix(rows, dim), k)) if rows.num_rows and queries.num_rows else []
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    found = right.cogroup(left).applyInArrow(lambda key, q, r: score(key, r, q), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
