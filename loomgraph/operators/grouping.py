"""Connected groups of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: hashes as longs): equal roots for what is connected.

    Every node takes the smallest of its neighbourhood as parent, and edges are
    drawn between the parents, until none is left.  As the nodes are hashes, a
    round leaves a constant share of them, so that rounds grow with the logarithm
    of the largest group.  Every round is written to the shared folder.
    """
    current = materialize(edges.select("a", "b").where("a <> b").distinct(), "group-edges")
    nodes = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "group-nodes")
    roots = nodes.withColumn("root", F.col("node"))
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialize(both.groupBy(F.col("a").alias("root")).agg(F.least(F.min("b"), F.min("a")).alias("parent")), "group-parents")
        roots = materialize(
            roots.join(parents, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "group-roots"
        )
        ends = current.join(parents.toDF("a", "pa"), "a").join(parents.toDF("b", "pb"), "b")
        current = materialize(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "group-edges")
    return roots
