"""Edges that follow a change: only what touches changed symbols, calls or refs is derived again.

Every rule is an equi-join, so an edge can only come or go if the row of one of
its ends, or the calls and refs of its source, have changed.  ``edge_changes``
names those ids for each edge kind and derives all edges that have one of them as
an end, joining the changed side with the stored other side in both directions.
Old edges with such an end are void, all others stay as they are and need not be
read.

Two kinds reach further.  IMPLEMENTS of Go compares method sets, so an owner is
touched if its set has changed; it is compared with the owners that share a
method name with it.  OVERRIDES looks at the methods of two types, so all
methods of types whose methods or super types have changed are touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import rules
from loomgraph.session import materialize

#: What the rules and the attribution of calls see of a symbol.
SEEN = ("repo_id", "file_id", "lang", "kind", "name", "fqn")
KINDS = ("CALLS", "CONTAINS", "DECLARES", "IMPORTS", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "REFERENCES")


def at(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose ``column`` is one of the ids."""
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_semi").select(*rows.columns)


def not_at(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is none of the ids."""
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)


def either(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ids_of(*parts: DataFrame) -> DataFrame:
    """Distinct ids (id) of one-column tables."""
    return either(*[p.toDF("id") for p in parts]).where("id IS NOT NULL").distinct()


def changed_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id) of symbols that came, went, or differ in what the rules see."""
    sides = before.select("id", *SEEN, F.lit(1).alias("side")).unionByName(after.select("id", *SEEN, F.lit(-1).alias("side")))
    return sides.groupBy("id", *SEEN).agg(F.sum("side").alias("n")).where("n <> 0").select("id").distinct()


def contains(symbols: DataFrame, children: DataFrame | None = None, parents: DataFrame | None = None) -> DataFrame:
    """The CONTAINS edges between some children and some parents, all by default."""
    found = rules.structural_edges(symbols if children is None else children, parents=symbols if parents is None else parents)
    return found.where("kind = 'CONTAINS'")


def _method_sets_near(symbols: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, their CONTAINS edges) of the owners and all others that share a method name with one of them."""
    methods = symbols.where("kind = 'method'")
    own = contains(symbols, children=methods, parents=at(symbols, owners))
    names = at(methods, own.select(F.col("dst").alias("id"))).select("repo_id", "name").distinct()
    alike = methods.join(names, ["repo_id", "name"], "left_semi").select(*methods.columns)
    others = contains(symbols, children=alike, parents=symbols.where(F.col("kind").isin("interface", "type")))
    around = materialize(ids_of(owners.select("id"), others.select("src")), "near-owners")
    held = materialize(contains(symbols, children=methods, parents=at(symbols, around)), "near-method-sets")
    return at(symbols, ids_of(around.select("id"), held.select("dst"))), held


def implements_go_at(symbols: DataFrame, owners: DataFrame) -> DataFrame:
    """IMPLEMENTS edges of Go that one of the owners (id) is an end of."""
    near, held = _method_sets_near(symbols, owners)
    found = materialize(rules.implements_go_edges(near, held), "near-implements")
    return either(at(found, owners, "src"), at(found, owners, "dst")).distinct()


def hierarchy_at(symbols: DataFrame, refs: DataFrame, types: DataFrame, of_go: bool = True) -> DataFrame:
    """EXTENDS and IMPLEMENTS edges that one of the types (id) is an end of; without ``of_go`` there are no method sets of Go."""
    here, said = at(symbols, types), at(refs, types, "src")
    parts = [f(*sides) for f in (rules.extends_edges, rules.implements_java_edges) for sides in ((symbols, said), (here, refs))]
    return either(*parts, *([implements_go_at(symbols, types)] if of_go else [])).distinct()


def overrides_at(symbols: DataFrame, refs: DataFrame, methods: DataFrame, of_go: bool = True) -> DataFrame:
    """OVERRIDES edges that one of the methods (id) is an end of."""
    types = materialize(ids_of(contains(symbols, children=at(symbols, methods)).select("src")), "override-owners")
    above = materialize(hierarchy_at(symbols, refs, types, of_go), "override-hierarchy")
    around = ids_of(types.select("id"), above.select("src"), above.select("dst"))
    members = contains(symbols, children=symbols.where("kind = 'method'"), parents=at(symbols, materialize(around, "override-types")))
    found = materialize(rules.override_edges(symbols, members.unionByName(above)), "near-overrides")
    return either(at(found, methods, "src"), at(found, methods, "dst")).distinct()


def edge_changes(
    before: dict[str, DataFrame], after: dict[str, DataFrame], files: DataFrame, *, calls: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(touched, fresh): ids by edge kind whose old edges are void (kind, id), and all edges now that have one of them as an end.

    ``before`` and ``after`` hold symbols, callsites and refs, of ``after`` as
    stored tables; ``files`` (file_id) are those whose rows were replaced or removed.
    Without ``calls`` no CALLS edges are derived: ``rules.call_ends`` stands for them.
    """
    symbols, callsites, refs = (after[name] for name in ("symbols", "callsites", "refs"))
    changed = materialize(changed_symbols(before["symbols"], symbols), "changed-symbols")

    def of_files(rows: DataFrame) -> DataFrame:
        return rows.join(files, "file_id", "left_semi")

    callers = materialize(ids_of(changed, *[of_files(t["callsites"]).select("caller") for t in (before, after)]), "touched-callers")
    sources = materialize(ids_of(changed, *[of_files(t["refs"]).select("src") for t in (before, after)]), "touched-sources")
    # rules without rows of the languages and kinds they speak of are not planned at all
    kinds, said_by = _kinds(before["symbols"], symbols), _provenances(before["refs"], refs)
    of_go = ("go", "type") in kinds and {"interface", "method"} <= {k for _, k in kinds}
    of_java = ("java", "method") in kinds
    types, methods = sources, changed
    if of_go or of_java:
        # owners that gained, lost or kept a changed method
        owners = [contains(t["symbols"], children=at(t["symbols"], changed)).select("src") for t in (before, after)]
        types = materialize(ids_of(sources.select("id"), *owners), "touched-types")
    if of_java:
        held = [contains(t["symbols"], children=t["symbols"].where("kind = 'method'"), parents=at(t["symbols"], types)).select("dst") for t in (before, after)]
        methods = materialize(ids_of(changed, *held), "touched-methods")
    here, said = at(symbols, sources), at(refs, sources, "src")
    fresh = [
        rules.structural_edges(at(symbols, changed), parents=symbols), rules.structural_edges(symbols, parents=at(symbols, changed)),
    ]
    if "extractor" in said_by:
        fresh += [rules.import_edges(symbols, said), rules.import_edges(here, refs)]
    if of_go or said_by & {"extends-heuristic", "implements-heuristic"}:
        fresh.append(hierarchy_at(symbols, refs, types, of_go))
    if of_java:
        fresh.append(overrides_at(symbols, refs, methods, of_go))
    if "type-ref" in said_by:
        for derive, langs in ((rules.reference_fqn_edges, {"go", "java"}), (rules.reference_suffix_edges, {"javascript", "typescript"})):
            if langs & {lang for lang, _ in kinds}:
                fresh += [derive(symbols, said), derive(symbols, refs, targets=here)]
    touched = {
        "CALLS": callers, "CONTAINS": changed, "DECLARES": changed, "IMPORTS": sources, "EXTENDS": types, "IMPLEMENTS": types,
        "REFERENCES": sources, "OVERRIDES": methods,
    }
    fresh = either(*fresh).distinct()
    if calls:
        # what touched callers call, and what others call of them: no edge twice, so that these, often most of all, need no distinct
        fresh = fresh.unionByName(rules.call_edges(symbols, at(callsites, callers, "caller"))).unionByName(
            rules.call_edges(at(symbols, callers), not_at(callsites, callers, "caller"))
        )
    return either(*[ids.select(F.lit(kind).alias("kind"), "id") for kind, ids in touched.items()]), fresh


def _kinds(*tables: DataFrame) -> set[tuple[str, str]]:
    """(lang, kind) of the symbols: as many as the extractors know, never more with more rows."""
    return {tuple(r) for r in either(*[t.select("lang", "kind") for t in tables]).distinct().collect()}


def _provenances(*tables: DataFrame) -> set[str]:
    return {r.provenance for r in either(*[t.where("src IS NOT NULL").select("provenance") for t in tables]).distinct().collect()}


def untouched(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """The edges none of whose ends is touched for their kind."""
    for end in ("src", "dst"):
        edges = edges.join(touched.withColumnRenamed("id", end), ["kind", end], "left_anti").select(*edges.columns)
    return edges
