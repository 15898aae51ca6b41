"""Connected components by alternating large and small stars on staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # a plain table, here and below, so that the edges of a hot node may be split
    least = common.sized(common.staged(least, "stars-least"), 100)
    return both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. Edges run from larger to smaller."""
    least = common.staged(edges.groupBy("a").agg(F.min("b").alias("m")), "stars-least")
    near = edges.join(common.sized(least, 100), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("sum(cast(xxhash64(b, a) as decimal(20,0)))").alias("s")).first()
    return r["n"], r["x"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """Rows (a, b): each node of the edges (a, b) but the least of its component, with that least node.

    Rounds end when a round changes nothing; there are about as many as the logarithm of the longest
    path. Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.staged(now, "stars")
    before = _mark(now)
    while True:
        now = common.staged(_small(common.staged(_large(now), "stars")), "stars")
        after = _mark(now)
        if after == before:
            return now
        before = after
