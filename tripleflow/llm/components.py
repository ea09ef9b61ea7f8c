"""Smallest label reachable over links, by alternating star joins of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleflow.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each node on its smallest neighbour (or itself).

    The large star moves only greater neighbours, the small star only smaller ones and the
    node itself.  A node with very many links is one aggregate and one join key, which
    adaptive execution splits; no list of neighbours is built.
    """
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("a", "m"))
    moved = around.join(least, "a")
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    hung = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that has a link; ``links`` has long columns ``a`` and ``b``.

    Each round is written to the shared folder.  The number of rounds grows with the
    logarithm of the longest path, and the loop ends when a round changes nothing.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = written(_star(_star(now, large=True), large=False), "stars")
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    ends = roots.select("root").distinct().select(F.col("root").alias("node"), "root")
    return roots.select(F.col("a").alias("node"), "root").unionByName(ends)
