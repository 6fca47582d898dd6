"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SALTS = 16


def _relinked(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's neighbours to the least node of its neighbourhood: the larger ones, or the smaller."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.filter("a > b").union(edges.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    # the centre of a star may have a third of all edges: they meet its row in SALTS tasks
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["a", "salt"]).drop("salt")
    out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns (node, root) for every node with an edge; root is the least node it reaches.

    Rounds grow with the logarithm of a component's size; each one is staged. Only a count and a sum of hashes
    come to the driver.
    """
    edges = common.stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before, now = None, edges.agg(mark).first()
    while before != now:
        edges = common.stage(_relinked(_relinked(edges, True), False), "edges")
        before, now = now, edges.agg(mark).first()
    roots = edges.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b").distinct())
