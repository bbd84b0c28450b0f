"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.storage import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_smallest(edges: DataFrame) -> DataFrame:
    """Edges with ``m``, the smallest of a node and its neighbours. The aggregate combines on the
    map side and is written, so that the join shuffles both sides for itself and Spark may split it
    where a node has very many neighbours."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    return edges.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    found = _with_smallest(_both_ways(edges))
    return found.filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_smallest(edges)
    near = found.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(found.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, root being the smallest node of its component.

    ``edges`` has columns a and b of one type. Each round is written to the shared folder, so no
    round depends on what an executor keeps; the loop ends when a round changes nothing.
    """
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "links")
    seen = None
    while True:
        now = materialize(_small_star(_large_star(now)), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
