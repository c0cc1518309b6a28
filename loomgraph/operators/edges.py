"""Keeping one edge table: first writer wins, semantic upgrades, rebuilds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("repo_id", "kind", "src", "dst")


def as_edges(pairs: DataFrame, kind: str | Column, confidence: float, provenance: str, *more: str) -> DataFrame:
    """(repo_id, src, dst) rows as edge rows of one kind; the columns ``more`` stay."""
    return pairs.select(
        "repo_id",
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        F.col("src").cast("long").alias("src"),
        F.col("dst").cast("long").alias("dst"),
        F.lit(confidence).cast("double").alias("confidence"),
        F.lit(provenance).alias("provenance"),
        *more,
    )


def first_wins(edges: DataFrame, order: Sequence[str], values: Sequence[str] = ("confidence", "provenance")) -> DataFrame:
    """One row per edge key: the one that comes first by ``order``."""
    best = F.min(F.struct(*order, *values)).alias("best")
    return edges.groupBy(*KEY).agg(best).select(*KEY, *[F.col(f"best.{v}").alias(v) for v in values])


def union_rules(outputs: Sequence[DataFrame]) -> DataFrame:
    """Union of rule outputs; an edge derived twice keeps the earlier rule's row."""
    ranked = None
    for rank, output in enumerate(outputs):
        rows = output.withColumn("rule_rank", F.lit(rank))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return first_wins(ranked, ["rule_rank"])


def add_missing(first: DataFrame, others: DataFrame) -> DataFrame:
    """All of ``first`` and the ``others`` whose key it lacks; both are without repeated keys, and ``first`` is best the smaller."""
    return first.unionByName(others.join(first.select(*KEY), list(KEY), "left_anti").select(*first.columns))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing edges stay; incoming edges with a new key are added once."""
    return first_wins(
        existing.withColumn("rule_rank", F.lit(0)).unionByName(incoming.withColumn("rule_rank", F.lit(1))),
        ["rule_rank"],
    )


class DuplicateEdges(ValueError):
    """A strict insert met a key that is already there."""


def strict_insert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append, but refuse the whole batch if any key would appear twice."""
    both = existing.unionByName(incoming)
    clash = both.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if not clash.isEmpty():
        raise DuplicateEdges(f"duplicate edge key: {clash.first().asDict()}")
    return both


def semantic_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert semantic edges; an existing edge is replaced only by a higher confidence.

    Among incoming rows of one key the first by ``seq`` (if present) reaches a
    confidence first and keeps it.
    """
    order = ["seq"] if "seq" in incoming.columns else []
    seq = F.col("seq").cast("long") if order else F.lit(0).cast("long")
    both = existing.select(*KEY, "confidence", "provenance", F.lit(-1).cast("long").alias("seq")).unionByName(
        incoming.select(*KEY, "confidence", "provenance", seq.alias("seq"))
    )
    best = F.min(F.struct((-F.col("confidence")).alias("rank"), "seq", "confidence", "provenance")).alias("best")
    return both.groupBy(*KEY).agg(best).select(*KEY, "best.confidence", "best.provenance")


def drop_derived(edges: DataFrame, symbols: DataFrame, kind: str, provenance: str, lang: str) -> DataFrame:
    """Edges without those of one kind and provenance whose source is in ``lang``."""
    stale = (F.col("kind") == kind) & (F.col("provenance") == provenance)
    of_lang = symbols.where(F.col("lang") == lang).select(F.col("id").alias("src"))
    kept = edges.where(stale).join(of_lang, "src", "left_anti")
    return edges.where(~stale).unionByName(kept.select(*edges.columns))


def rebuild(
    edges: DataFrame, symbols: DataFrame, kind: str, provenance: str, lang: str, derived: DataFrame
) -> DataFrame:
    """Delete one derived family, then insert what the rule derives now."""
    return insert_or_ignore(drop_derived(edges, symbols, kind, provenance, lang).select(*derived.columns), derived)


def cascade(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose two ends still exist."""
    ids = symbols.select("id")
    return (
        edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .select(*edges.columns)
    )


def set_null_missing(rows: DataFrame, columns: Sequence[str], symbols: DataFrame) -> DataFrame:
    """Set symbol references to NULL where the symbol no longer exists."""
    order = rows.columns
    for name in columns:
        alive = symbols.select(F.col("id").alias(name), F.lit(True).alias("__alive"))
        rows = rows.join(alive, name, "left").withColumn(name, F.when(F.col("__alive"), F.col(name))).drop("__alive")
    return rows.select(*order)
