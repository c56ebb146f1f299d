"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); the root is the smallest node reachable.

    Each round every node takes its smallest neighbour's parent; edges are rewritten and those
    inside one class go, until none is left. Minima are pre-aggregated before each shuffle and
    joins on a hot parent can be split, so that a star with very many leaves is no problem. No link
    comes to the driver.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    roots = None
    while True:
        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionAll(edges.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
        parent = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root"))
        above = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = stage(parent.join(above, "root").select("node", F.col("top").alias("root")))
        if roots is None:
            roots = moved
        else:
            then = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = stage(roots.join(then, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        for end in ("hi", "lo"):
            edges = edges.join(moved.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end).drop(end).withColumnRenamed(f"{end}_root", end)
        edges = stage(edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
        if edges.isEmpty():
            return roots
