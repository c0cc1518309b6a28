"""Repository counts, node degrees and the concentric ring layout."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize

# Share of nodes up to each ring, radii and spacing of the layout.
RING_FRACTIONS = (0.05, 0.15, 0.35, 1.0)
INNER_RADIUS = 60.0
MIN_GAP = 70.0
ARC_SMALL, ARC_MEDIUM, ARC_LARGE = 28.0, 18.0, 12.0

#: Id ranges a rank is split into, so that equal degrees do not share one task.
RANK_BUCKETS = 4096


def repo_counts(repos: DataFrame, files: DataFrame, symbols: DataFrame, callsites: DataFrame) -> DataFrame:
    """Files, symbols, call sites, resolved call sites, last index time and percentage per repo."""
    f = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.max("indexed_at").alias("last_indexed"))
    s = symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"))
    c = callsites.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("callsites"), F.count("resolved").alias("resolved")
    )
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("files", "symbols", "callsites", "resolved")]
    return (
        repos.select(F.col("id").alias("repo_id"), "name")
        .join(f, "repo_id", "left").join(s, "repo_id", "left").join(c, "repo_id", "left")
        .select(
            "repo_id", "name", *counts,
            F.coalesce(F.col("last_indexed").cast("string"), F.lit("never")).alias("last_indexed"),
        )
        .withColumn(
            "resolved_pct",
            F.when(F.col("callsites") > 0, F.col("resolved") * 100.0 / F.col("callsites")).otherwise(0.0),
        )
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): in plus out, a self loop counts twice, isolated nodes have 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("degree")
    )
    return nodes.select("id").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): node and edge totals, overall and per kind."""
    def totals(df: DataFrame, what: str) -> DataFrame:
        return df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")

    return totals(nodes, "nodes").unionByName(totals(edges, "edges"))


def degree_ranks(degree: DataFrame) -> DataFrame:
    """(id, degree, rank): position by degree, high to low, ties by id, from 1.

    The rank is an offset per degree, plus an offset per id range inside the
    degree, plus a row number inside that range.  Only the histogram of
    degrees goes through one task: m edges have fewer than 2 * sqrt(m) + 1
    different degrees.
    """
    low, high = degree.agg(F.min("id")).scalar(), degree.agg(F.max("id")).scalar()
    share = (F.col("id").cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double") + 1.0)
    parts = degree.withColumn("bucket", F.least(F.floor(share * RANK_BUCKETS), F.lit(RANK_BUCKETS - 1)))
    sizes = parts.groupBy("degree", "bucket").agg(F.count(F.lit(1)).alias("n"))
    per_degree = sizes.groupBy("degree").agg(F.sum("n").alias("n"))
    before = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_degree.select("degree", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    inside = Window.partitionBy("degree").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("lower", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, "degree")
        .select("degree", "bucket", (F.col("above") + F.col("lower")).alias("start"))
    )
    number = F.row_number().over(Window.partitionBy("degree", "bucket").orderBy("id"))
    return (
        parts.withColumn("number", number)
        .join(starts, ["degree", "bucket"])
        .select("id", "degree", (F.col("start") + F.col("number")).alias("rank"))
    )


def ring_layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, rank, ring, x, y): high degrees inside, four rings of growing share."""
    degree = materialize(degrees(nodes, edges), "degrees")
    total = degree.count()
    arc = ARC_SMALL if total < 100 else ARC_MEDIUM if total < 500 else ARC_LARGE
    ring, radius, begin, size = (F.lit(None).cast("double") for _ in range(4))
    ring = F.lit(None).cast("int")
    start, previous, rings = 0, 0.0, []
    for i, fraction in enumerate(RING_FRACTIONS):
        end = min(math.ceil(fraction * total), total)
        count = max(end - start, 0)
        spacing = INNER_RADIUS if count <= 1 else count * arc / (2 * math.pi)
        r = max(INNER_RADIUS if i == 0 else previous + MIN_GAP, spacing)
        rings.append((i, start, end, max(count, 1), r))
        start, previous = end, r
    for i, first, end, count, r in reversed(rings):
        here = F.col("rank") <= end
        ring = F.when(here, i).otherwise(ring)
        radius = F.when(here, r).otherwise(radius)
        begin = F.when(here, float(first)).otherwise(begin)
        size = F.when(here, float(count)).otherwise(size)
    angle = F.lit(2 * math.pi) * (F.col("rank") - 1 - F.col("begin")) / F.col("size")
    return (
        degree_ranks(degree)
        .select("id", "degree", "rank", ring.alias("ring"), radius.alias("radius"), begin.alias("begin"),
                size.alias("size"))
        .select("id", "degree", "rank", "ring",
                (F.col("radius") * F.cos(angle)).alias("x"), (F.col("radius") * F.sin(angle)).alias("y"))
    )
