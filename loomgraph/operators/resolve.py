"""Semantic upgrade from collected locations: definitions, implementations, super types.

The locations come as tables; how they were obtained is up to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import parse_locations, uri_to_path
from loomgraph.operators.incremental import mark_resolved, unresolved_callsites
from loomgraph.operators.spans import locate_or_match, locate_symbols
from loomgraph.session import materialize

SEMANTIC = 1.0
# Fixed value: the symbol kind number of an interface in a type hierarchy answer.
INTERFACE_KIND = 11
DEFAULT_BUDGET = 1000


def read_locations(answers: DataFrame, root: str) -> DataFrame:
    """JSON answers (key columns..., raw) as one row per location (..., pos, path, line)."""
    keys = [c for c in answers.columns if c != "raw"]
    return answers.select(*keys, F.posexplode(parse_locations("raw")).alias("pos", "loc")).select(
        *keys, "pos", uri_to_path("loc.uri", F.lit(root)).alias("path"), F.col("loc.line").alias("line")
    )


def resolve_callsites(
    callsites: DataFrame, definitions: DataFrame, symbols: DataFrame, files: DataFrame, provenance: str
) -> tuple[DataFrame, DataFrame]:
    """Resolve call sites from definitions (callsite_id, path, line).

    Returns the call sites with ``resolved`` set where a symbol was found, and
    the CALLS edges of those with a known caller, ready for semantic_upsert.
    """
    open_ = callsites.where("resolved IS NULL").select(
        F.col("id").alias("callsite_id"), "repo_id", "callee_text", "caller"
    )
    wanted = definitions.join(open_, "callsite_id").select(
        F.col("callsite_id").alias("loc_id"), "repo_id", "path", "line", "callee_text", "caller"
    )
    found = materialize(
        locate_or_match(wanted.drop("caller"), symbols, files).join(wanted.select("loc_id", "repo_id", "caller"), "loc_id"),
        "resolved-calls",
    )
    edges = found.where("caller IS NOT NULL").select(
        "repo_id", F.lit("CALLS").alias("kind"), F.col("caller").alias("src"), F.col("symbol_id").alias("dst"),
        F.lit(SEMANTIC).alias("confidence"), F.lit(provenance).alias("provenance"),
    )
    resolutions = found.select(F.col("loc_id").alias("id"), "symbol_id")
    return mark_resolved(callsites, resolutions), edges.distinct()


#: resolver(work list) -> definitions (callsite_id, path, line).
Resolver = Callable[[DataFrame], DataFrame]


def run_resolver(
    resolver: Resolver, callsites: DataFrame, symbols: DataFrame, files: DataFrame, provenance: str,
    budget: int = DEFAULT_BUDGET,
) -> tuple[DataFrame, DataFrame]:
    """Ask a user resolver about the next unresolved call sites and apply its answers."""
    work = materialize(unresolved_callsites(callsites, budget), "resolver-worklist")
    definitions = materialize(resolver(work), "definitions")
    return resolve_callsites(callsites, definitions, symbols, files, provenance)


def implementation_edges(implementations: DataFrame, symbols: DataFrame, files: DataFrame, provenance: str) -> DataFrame:
    """OVERRIDES edges from implementation locations (symbol_id, path, line).

    The implementing method is the source, the asked method the target.
    """
    located = _located(implementations, symbols, files)
    return located.select(
        "repo_id", F.lit("OVERRIDES").alias("kind"), F.col("found").alias("src"), F.col("symbol_id").alias("dst"),
        F.lit(SEMANTIC).alias("confidence"), F.lit(provenance).alias("provenance"),
    ).distinct()


def hierarchy_edges(supertypes: DataFrame, symbols: DataFrame, files: DataFrame, provenance: str) -> DataFrame:
    """EXTENDS / IMPLEMENTS edges from super types (symbol_id, path, line, parent_kind).

    A class below an interface implements it; every other pair extends.
    """
    located = _located(supertypes, symbols, files)
    kind = F.when((F.col("kind") == "class") & (F.col("parent_kind") == INTERFACE_KIND), "IMPLEMENTS").otherwise("EXTENDS")
    return located.select(
        "repo_id", kind.alias("edge_kind"), F.col("symbol_id").alias("src"), F.col("found").alias("dst"),
        F.lit(SEMANTIC).alias("confidence"), F.lit(provenance).alias("provenance"),
    ).withColumnRenamed("edge_kind", "kind").distinct()


def _located(answers: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    asked = symbols.select(F.col("id").alias("symbol_id"), "repo_id", "kind")
    rows = materialize(
        answers.join(asked, "symbol_id").withColumn("loc_id", F.xxhash64("symbol_id", "path", "line")), "located"
    )
    places = rows.select("loc_id", "repo_id", "path", "line").distinct()
    hits = locate_symbols(places, symbols, files).withColumnRenamed("symbol_id", "found")
    return rows.join(hits, "loc_id")


def worklist(symbols: DataFrame, files: DataFrame, kinds: Sequence[str], limit: int = DEFAULT_BUDGET) -> DataFrame:
    """Java symbols to ask about, in path and line order."""
    java = files.where("lang = 'java'").select(F.col("id").alias("file_id"), "path")
    return (
        symbols.where(F.col("kind").isin(*kinds) & (F.col("start_col") > 0))
        .select("id", "file_id", "start_line", "start_col", "kind")
        .join(java, "file_id")
        .orderBy("path", "start_line", "id")
        .limit(limit if limit > 0 else DEFAULT_BUDGET)
    )
