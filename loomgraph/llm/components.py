"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialize


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    others = edges.join(least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return others.union(least.select("src", F.col("low").alias("dst")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst: long); root is the smallest node reachable.

    Every round is written to the shared folder, so that a lost executor costs
    one round.  Rounds grow with the logarithm of the longest path.
    """
    def turned(df: DataFrame) -> DataFrame:
        return df.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()

    current = materialize(turned(edges), name)
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        current = materialize(_small(turned(_large(current))).distinct(), name)
    roots = current.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return roots.union(current.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
