"""Connected components by alternating large-star and small-star rounds.

Every round rewrites the edge set so that nodes point at smaller ones; it ends when the
edges no longer change and each node of a component points at its smallest member.  Minima
are combined before the shuffle, and the join that follows only fans out, so a node with
very many neighbours is split by adaptive skew handling.  Rounds are cut from each other
by tables in the shared checkpoint folder, which survive lost executors; a round's table is
deleted once the next one is written, and its count and digest are taken by the write itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscribe.sources.scratch import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v <> m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` of every node that has an edge to another; ``component`` is its
    smallest reachable node.  Null ends and loops are ignored; edges may repeat."""
    a, b = F.col(src), F.col(dst)
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (a != b))
    work, turn, before = Workspace(edges.sparkSession, "components"), 0, None
    state = {"n": F.count(F.lit(1)), "digest": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, now = work.save(edges.distinct(), "0", **state)
    while now != before and now["n"]:
        before, turn = now, turn + 1
        edges, now = work.save(_small_star(_large_star(edges).distinct()).distinct(), str(turn), **state)
        work.drop(str(turn - 1))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select("component", "component").distinct())
