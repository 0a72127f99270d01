"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation with partial minima and one join on the node; both sides are shuffled right below the
join, so a node with very many edges is split by adaptive execution. Each round is a staged table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import drop_staged, stage_counted



def _check() -> Column:
    """Number and hash sum of the edges: equal in two rounds when nothing changed."""
    return F.struct(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return (
        joined.where("b != m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); the root is the smallest node of the component."""
    now, before = stage_counted(_small_star(edges), "edges", _check())
    while True:
        after, check = stage_counted(_small_star(_large_star(now)), "edges", _check())
        drop_staged(now)
        now = after
        if check == before:
            break
        before = check
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
