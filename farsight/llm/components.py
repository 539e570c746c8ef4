"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farsight.llm.common import shared_folder


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _open_ends(edges: DataFrame) -> DataFrame:
    """Nodes by which the edges are not yet stars: with two parents, or with a parent and children."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return ends.filter("child > 1 or (child = 1 and root = 1)")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of edges; the component is its smallest node.

    Each round is checkpointed; the number of rounds grows with the logarithm of the longest path, and edges that are stars need none.
    Nulls and loops are no edges. An empty table gives an empty table."""
    shared_folder(edges.sparkSession)
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
        .checkpoint()
    )
    while not _open_ends(now).isEmpty():
        now = _small_star(_large_star(now)).checkpoint()
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
