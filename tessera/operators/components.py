"""Connected components by alternating star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import write_table


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: each node's neighbours (those above it, or those below) go to the least.

    A node's least neighbour is a partial aggregate, and the links are joined back to it, so
    that no node's links are gathered in one task, however many it has.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both if larger else both.filter("b <= a")
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = links.join(least, "a")
    if larger:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``a, root`` for every node of ``edges(a, b)`` that has a link; root is the least node.

    Alternating large and small star steps end in stars around each component's least node
    after about log n rounds. Each round is a table in the shared folder, so lineage stays
    short. Self links are ignored. Raises if the links haven't settled after ``max_rounds``.
    """
    normal = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = write_table(normal.distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        now = write_table(_star(_star(now, True), False), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select("a", F.col("b").alias("root")).union(now.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
        mark = seen
    raise RuntimeError("links did not settle")
