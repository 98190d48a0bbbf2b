"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a").where("b > a")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b")))


def _print(e: DataFrame):
    return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of every node in an edge (a, b); component is its smallest reachable node.

    Each round writes its edges to the shared folder, so a lost executor costs one round
    at most.  Rounds grow with the logarithm of the longest path.  No edges: no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _print(e)
    while before["n"]:
        last, e = e, stored(_small_star(_large_star(e).distinct()).distinct(), "edges")
        discard(last)
        now = _print(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
