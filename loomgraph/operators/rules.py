"""Edge derivation rules: symbols, call sites and refs in, edges out.

Every rule joins inside one repository.  Rules with the same join key share one
join: the ten containment rules are one join on the parent's FQN, and the calls
of all languages are one join on the callee's name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import callee_key, hash_owner, parent_by_name, parent_if_suffix, receiver_owner
from loomgraph.functions.text import ascii_lower
from loomgraph.operators.edges import as_edges, union_rules
from loomgraph.operators.skew import hot_keys, salted_join, spread_join, spread_pairs
from loomgraph.operators.spans import attribute_callers
from loomgraph.session import materialize

# Confidence and provenance of the derived edge kinds.
STRUCTURAL = (1.0, "extractor")
IMPORT = (0.8, "extractor")
HEURISTIC = (0.5, "heuristic")
REFERENCE = (0.4, "heuristic")
CALL = (0.4, "treesitter")

#: Up to so many repositories with callees are named in the filter of the call sites; others of theirs are not read.
NAMED_REPOS = 1000
#: Callable kinds a call may link to, by language of the callee.
CALLEE_KINDS = {
    "go": ("function", "method"),
    "java": ("function", "method"),
    "javascript": ("function", "method"),
    "typescript": ("function", "method", "arrow_function"),
}
#: Kinds a type reference may link to; only for languages matched by FQN suffix.
SUFFIX_KINDS = {
    "javascript": ("class",),
    "typescript": ("interface", "class", "type_alias", "enum"),
}
NOT_DECLARED = ("package", "method", "field", "constructor")


@dataclass(frozen=True)
class ParentRule:
    """One containment rule: which children, the parent's FQN, which parents."""

    edge: str
    child: Column
    parent_fqn: Column
    parent: Column


def _parent_rules() -> dict[str, ParentRule]:
    c_lang, c_kind, c_fqn = F.col("c_lang"), F.col("c_kind"), F.col("c_fqn")
    p_lang, p_kind = F.col("p_lang"), F.col("p_kind")
    suffix = parent_if_suffix("c_fqn", "c_name")
    other = F.col("src") != F.col("dst")
    has_receiver = F.contains("c_fqn", F.lit(".("))
    has_hash = F.contains("c_fqn", F.lit("#"))
    java_types = ("class", "interface", "enum")
    script_fn = ("method", "function", "arrow_function")
    declared = ~c_kind.isin(*NOT_DECLARED)
    return {
        "declares_go": ParentRule("DECLARES", declared, suffix, (p_lang == "go") & (p_kind == "package") & other),
        "declares_java": ParentRule("DECLARES", declared, suffix, (p_lang == "java") & (p_kind == "package") & other),
        "contains_go_method": ParentRule(
            "CONTAINS", (c_lang == "go") & (c_kind == "method") & has_receiver,
            receiver_owner("c_fqn"), p_kind.isin("type", "interface"),
        ),
        "contains_go_member": ParentRule(
            "CONTAINS", (c_lang == "go") & c_kind.isin("method", "field") & ~has_receiver & ~has_hash,
            parent_by_name("c_fqn", "c_name"), p_kind.isin("type", "interface"),
        ),
        "contains_go_package": ParentRule(
            "CONTAINS", c_kind.isin("type", "interface"), suffix, (p_lang == "go") & (p_kind == "package") & other,
        ),
        "contains_java_field": ParentRule(
            "CONTAINS", (c_lang == "java") & (c_kind == "field") & ~has_hash,
            parent_by_name("c_fqn", "c_name"), p_kind.isin(*java_types),
        ),
        "contains_java_method": ParentRule(
            "CONTAINS", (c_lang == "java") & c_kind.isin("method", "constructor") & has_hash,
            hash_owner(c_fqn), p_kind.isin(*java_types),
        ),
        "contains_java_package": ParentRule(
            "CONTAINS", c_kind.isin(*java_types), suffix, (p_lang == "java") & (p_kind == "package") & other,
        ),
        "contains_javascript": ParentRule(
            "CONTAINS", (c_lang == "javascript") & c_kind.isin("method", "function"), suffix, p_kind == "class",
        ),
        "contains_typescript": ParentRule(
            "CONTAINS", (c_lang == "typescript") & c_kind.isin(*script_fn, "enum_member"), suffix,
            (c_kind.isin(*script_fn) & p_kind.isin("class", "function", "arrow_function"))
            | ((c_kind == "enum_member") & (p_kind == "enum")),
        ),
    }


PARENT_RULES = (
    "declares_go", "contains_go_method", "contains_go_member", "contains_go_package",
    "declares_java", "contains_java_field", "contains_java_method", "contains_java_package",
    "contains_javascript", "contains_typescript",
)


def structural_edges(
    symbols: DataFrame, rules: Sequence[str] = PARENT_RULES, same_lang: bool = False, parents: DataFrame | None = None,
) -> DataFrame:
    """DECLARES and CONTAINS edges of the named rules, in one join on the parent FQN.

    The rules fix the language of one end only; ``same_lang`` asks for both.
    ``parents`` are the symbols that may be parents, all by default.
    """
    table = _parent_rules()
    chosen = {name: table[name] for name in rules}
    children = symbols.where("fqn IS NOT NULL").select(
        "repo_id", F.col("id").alias("dst"), F.col("lang").alias("c_lang"), F.col("kind").alias("c_kind"),
        F.col("name").alias("c_name"), F.col("fqn").alias("c_fqn"),
    )
    offers = F.filter(
        F.array(*[
            F.struct(F.lit(name).alias("rule"), F.when(rule.child, rule.parent_fqn).alias("fqn"))
            for name, rule in chosen.items()
        ]),
        lambda o: o["fqn"].isNotNull(),
    )
    asks = children.withColumn("offer", F.explode(offers)).select(
        "repo_id", "dst", "c_lang", "c_kind", F.col("offer.rule").alias("rule"), F.col("offer.fqn").alias("fqn")
    )
    parents = (symbols if parents is None else parents).where("fqn IS NOT NULL").select(
        "repo_id", "fqn", F.col("id").alias("src"), F.col("lang").alias("p_lang"), F.col("kind").alias("p_kind")
    )
    fits = F.lit(False)
    edge = F.lit(None).cast("string")
    for name, rule in chosen.items():
        this = F.col("rule") == name
        fits = fits | (this & rule.parent)
        edge = F.when(this, rule.edge).otherwise(edge)
    if same_lang:
        fits = fits & (F.col("p_lang") == F.col("c_lang"))
    pairs = salted_join(asks, parents, ["repo_id", "fqn"], spread_by=["dst"]).where(fits)
    return as_edges(pairs, edge, *STRUCTURAL).distinct()


def call_edges(
    symbols: DataFrame, callsites: DataFrame, langs: Sequence[str] = tuple(CALLEE_KINDS), *,
    same_lang: bool = False, last_part: bool = False,
) -> DataFrame:
    """CALLS edges: known caller -> every callable with the called name.

    ``same_lang`` also asks for a caller in the callee's language (the
    whole-repository variant of the script languages).
    """
    calls, callees = _call_sides(symbols, callsites, langs, last_part)
    on = ["repo_id", "name"]
    if same_lang:
        speakers = symbols.where(F.col("lang").isin(*langs)).select(F.col("id").alias("src"), "lang").distinct()
        calls = calls.join(speakers, "src")
        on = [*on, "lang"]
    # Stored, as pairs are counted first.  A call and a callee meet once: an id has one name and language.
    return as_edges(spread_pairs(materialize(calls, "calls"), callees, on, ["src"]), "CALLS", *CALL)


def call_ends(symbols: DataFrame, callsites: DataFrame) -> DataFrame:
    """The CALLS edges as their ends (repo_id, name, callee, id), as many as calls and callees and not as their pairs."""
    calls, callees = _call_sides(symbols, callsites, tuple(CALLEE_KINDS), False)
    return calls.select("repo_id", "name", F.lit(False).alias("callee"), F.col("src").alias("id")).unionByName(
        callees.select("repo_id", "name", F.lit(True).alias("callee"), F.col("dst").alias("id"))
    ).where("repo_id IS NOT NULL AND name IS NOT NULL")


def paired_calls(ends: DataFrame) -> DataFrame:
    """The CALLS edges of stored ends; other columns of the ends come along, as src_... and dst_... ."""
    more = [c for c in ends.columns if c not in ("repo_id", "name", "callee", "id")]

    def side(callee: bool, end: str) -> DataFrame:
        return ends.where(F.col("callee") == callee).select("repo_id", "name", F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in more])

    pairs = spread_pairs(side(False, "src"), side(True, "dst"), ["repo_id", "name"], ["src"])
    return as_edges(pairs, "CALLS", *CALL, *[f"{end}_{c}" for end in ("src", "dst") for c in more])


def _call_sides(symbols: DataFrame, callsites: DataFrame, langs: Sequence[str], last_part: bool) -> tuple[DataFrame, DataFrame]:
    """Calls (repo_id, src, name) and callees (repo_id, name, dst, lang), each row once."""
    callable_ = F.lit(False)
    for lang in langs:
        callable_ = callable_ | ((F.col("lang") == lang) & F.col("kind").isin(*CALLEE_KINDS[lang]))
    callees = symbols.where(callable_).select("repo_id", "name", F.col("id").alias("dst"), "lang").distinct()
    known = callsites.where("caller IS NOT NULL")
    repos = [r.repo_id for r in callees.where("repo_id IS NOT NULL").select("repo_id").distinct().limit(NAMED_REPOS + 1).collect()]
    if len(repos) <= NAMED_REPOS:
        known = known.where(F.col("repo_id").isin(*repos))
    return known.select("repo_id", F.col("caller").alias("src"), callee_key("callee_text", last_part).alias("name")).distinct(), callees


def import_edges(symbols: DataFrame, refs: DataFrame, langs: Sequence[str] = ("go", "java")) -> DataFrame:
    """IMPORTS edges: importing package -> imported package of the repository."""
    packages = symbols.where((F.col("kind") == "package") & F.col("lang").isin(*langs)).select(
        "repo_id", F.col("fqn").alias("ref_text"), F.col("id").alias("dst")
    )
    wanted = refs.where("src IS NOT NULL AND provenance = 'extractor'").select("repo_id", "src", "ref_text").distinct()
    return as_edges(salted_join(wanted, packages, ["repo_id", "ref_text"]), "IMPORTS", *IMPORT).distinct()


def _java_supertypes(symbols: DataFrame, refs: DataFrame, provenance: str, kinds: Sequence[str], edge: str) -> DataFrame:
    types = symbols.where((F.col("lang") == "java") & F.col("kind").isin(*kinds)).select(
        "repo_id", F.col("name").alias("ref_text"), F.col("id").alias("dst")
    )
    wanted = refs.where((F.col("provenance") == provenance) & F.col("src").isNotNull()).select(
        "repo_id", "src", "ref_text"
    ).distinct()
    return as_edges(salted_join(wanted, types, ["repo_id", "ref_text"]), edge, *HEURISTIC).distinct()


def extends_edges(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """EXTENDS edges of Java, by simple name of the super type."""
    return _java_supertypes(symbols, refs, "extends-heuristic", ("class", "interface"), "EXTENDS")


def implements_java_edges(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """IMPLEMENTS edges of Java, by simple name of the declared interface."""
    return _java_supertypes(symbols, refs, "implements-heuristic", ("interface",), "IMPLEMENTS")


def implements_go_edges(symbols: DataFrame, contains: DataFrame) -> DataFrame:
    """IMPLEMENTS edges of Go: the type has every method name of a non-empty interface.

    A relational division that avoids pairing everything that shares a name:
    each interface is first matched through its rarest method name only, and
    just those candidates are checked for the other names.
    """
    methods = symbols.where("kind = 'method'").select(F.col("id").alias("dst"), "name")
    owned = (
        contains.where("kind = 'CONTAINS'").select("src", "dst").join(methods, "dst")
        .select(F.col("src").alias("owner"), "name")
        .distinct()
    )
    owners = symbols.select(
        F.col("id").alias("owner"), "repo_id",
        F.when(F.col("kind") == "interface", "interface")
        .when((F.col("kind") == "type") & (F.col("lang") == "go"), "type").alias("role"),
    ).where("role IS NOT NULL")
    owned = materialize(owned.join(owners, "owner"), "method-sets")
    need = owned.where("role = 'interface'").select("repo_id", F.col("owner").alias("dst"), "name")
    have = owned.where("role = 'type'").select("repo_id", F.col("owner").alias("src"), "name")
    holders = have.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("holders"))
    plan = (
        need.join(holders, ["repo_id", "name"], "left")
        .groupBy("repo_id", "dst")
        .agg(
            F.count(F.lit(1)).alias("wanted"),
            F.min(F.struct(F.coalesce("holders", F.lit(0)).alias("n"), F.col("name"))).alias("rarest"),
        )
        .select("repo_id", "dst", "wanted", F.col("rarest.name").alias("name"))
    )
    candidates = salted_join(have, plan, ["repo_id", "name"], spread_by=["src"])
    alone = candidates.where("wanted = 1").select("repo_id", "src", "dst")
    open_ = candidates.where("wanted > 1").select("repo_id", "src", "dst", "wanted", F.col("name").alias("rarest"))
    checks = spread_join(open_, need, ["repo_id", "dst"], ["src"]).where("name <> rarest")
    full = (
        checks.join(have, ["repo_id", "src", "name"], "left_semi")
        .groupBy("repo_id", "src", "dst", "wanted")
        .agg(F.count(F.lit(1)).alias("found"))
        .where("found = wanted - 1")
        .select("repo_id", "src", "dst")
    )
    return as_edges(alone.unionByName(full).where("src <> dst"), "IMPLEMENTS", *HEURISTIC)


def override_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """OVERRIDES edges of Java: a method and the equally named method of a super type.

    ``edges`` must hold the CONTAINS, IMPLEMENTS and EXTENDS edges.
    """
    types = symbols.where(F.col("kind").isin("class", "interface")).select(F.col("id").alias("owner"))
    methods = symbols.where("kind = 'method'").select(
        F.col("id").alias("dst"), "name", F.col("lang"), "repo_id"
    )
    members = materialize(
        edges.where("kind = 'CONTAINS'").select(F.col("src").alias("owner"), "dst")
        .join(types, "owner")
        .join(methods, "dst"),
        "type-members",
    )
    supers = edges.where(F.col("kind").isin("IMPLEMENTS", "EXTENDS")).select(
        F.col("src").alias("owner"), F.col("dst").alias("above")
    ).distinct()
    lower = materialize(
        salted_join(
            members.where("lang = 'java'").select("owner", "repo_id", "name", F.col("dst").alias("src")),
            supers, ["owner"], spread_by=["src"],
        ).select("repo_id", "src", "name", F.col("above").alias("owner")),
        "lower-methods",
    )
    upper = members.select("owner", "name", "dst")
    pairs = salted_join(lower, upper, ["owner", "name"], spread_by=["src"]).where("src <> dst")
    return as_edges(pairs, "OVERRIDES", *HEURISTIC).distinct()


def _type_refs(symbols: DataFrame, refs: DataFrame, langs: Sequence[str]) -> DataFrame:
    """Type refs whose source symbol is in one of the languages: (repo_id, src, ref_text, lang)."""
    sources = symbols.where(F.col("lang").isin(*langs)).select(F.col("id").alias("src"), "lang")
    return _ref_texts(refs).distinct().join(sources, "src")


def _ref_texts(refs: DataFrame) -> DataFrame:
    return refs.where("provenance = 'type-ref' AND src IS NOT NULL").select("repo_id", "src", "ref_text")


def reference_fqn_edges(
    symbols: DataFrame, refs: DataFrame, langs: Sequence[str] = ("go", "java"), targets: DataFrame | None = None,
) -> DataFrame:
    """REFERENCES edges of Go and Java: the ref text is the FQN of the target, one of ``targets`` (default: all symbols)."""
    targets = (symbols if targets is None else targets).select("repo_id", F.col("fqn").alias("ref_text"), F.col("id").alias("dst"))
    on = ["repo_id", "ref_text"]
    pairs = salted_join(
        _type_refs(symbols, refs, langs).drop("lang"), targets, on, spread_by=["src"],
        hot=hot_keys(_ref_texts(refs), on),
    ).where("src <> dst")
    return as_edges(pairs, "REFERENCES", *REFERENCE).distinct()


def fqn_suffixes(fqn: Column) -> Column:
    """Every part of an FQN that follows a dot, longest first."""
    parts = F.split(fqn, r"\.")
    return F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def reference_suffix_edges(
    symbols: DataFrame, refs: DataFrame, langs: Sequence[str] = tuple(SUFFIX_KINDS), targets: DataFrame | None = None,
) -> DataFrame:
    """REFERENCES edges of the script languages: FQN equals the ref or ends with ``.ref``.

    The suffix match ignores ASCII case, equality does not.  Instead of testing
    all pairs, a target (one of ``targets``, default: all symbols) offers each of
    its dot suffixes as a join key.
    """
    fits = F.lit(False)
    for lang in langs:
        fits = fits | ((F.col("lang") == lang) & F.col("kind").isin(*SUFFIX_KINDS[lang]))
    targets = (symbols if targets is None else targets).where(fits).where("fqn IS NOT NULL").select(
        "repo_id", F.col("lang").alias("t_lang"), "fqn", F.col("id").alias("dst")
    )
    # An offer with ``whole`` set only counts if the ref equals the full FQN.
    offers = targets.select(
        "repo_id", "t_lang", "dst",
        F.explode(
            F.concat(
                F.array(F.struct(ascii_lower("fqn").alias("key"), F.col("fqn").alias("whole"))),
                F.transform(
                    F.when(F.contains("fqn", F.lit(".")), fqn_suffixes(ascii_lower("fqn")))
                    .otherwise(F.array().cast("array<string>")),
                    lambda tail: F.struct(tail.alias("key"), F.lit(None).cast("string").alias("whole")),
                ),
            )
        ).alias("offer"),
    ).select("repo_id", "t_lang", "dst", "offer.key", "offer.whole")
    on = ["repo_id", "key"]
    keyed = _ref_texts(refs).withColumn("key", ascii_lower("ref_text"))
    pairs = salted_join(
        _type_refs(symbols, refs, langs).withColumn("key", ascii_lower("ref_text")), offers, on,
        spread_by=["src"], hot=hot_keys(keyed, on),
    ).where("lang = t_lang AND src <> dst AND (whole IS NULL OR whole = ref_text)")
    return as_edges(pairs, "REFERENCES", *REFERENCE).distinct()


# --- binding of extracted names to symbols -----------------------------------

def bind_imports(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Import refs (repo_id, file_id, src_fqn, ref_text) bound to their package symbol."""
    packages = symbols.where("kind = 'package'")
    return _bind(packages, imports, 0.8, "extractor")


def bind_extends(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """Extends refs bound to the declaring Java class."""
    return _bind(symbols.where("lang = 'java'"), rows, 0.5, "extends-heuristic")


def bind_implements(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """Implements refs bound to the declaring Java class."""
    return _bind(symbols.where("lang = 'java'"), rows, 0.5, "implements-heuristic")


def bind_type_refs(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """Type refs bound to the symbol that mentions the type."""
    return _bind(symbols, rows, 0.4, "type-ref")


def _bind(symbols: DataFrame, rows: DataFrame, confidence: float, provenance: str) -> DataFrame:
    first = symbols.where("fqn IS NOT NULL").groupBy("repo_id", F.col("fqn").alias("src_fqn")).agg(
        F.min("id").alias("src")
    )
    return salted_join(rows, first, ["repo_id", "src_fqn"]).select(
        "repo_id", "file_id", "src", F.lit(None).cast("long").alias("dst"), "ref_text",
        F.lit(confidence).alias("confidence"), F.lit(provenance).alias("provenance"),
    )


# --- the whole build ---------------------------------------------------------

#: Extra rules: name -> callable(symbols, callsites, refs) -> edges.
Rule = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
_EXTRA_RULES: dict[str, Rule] = {}


def register_rule(name: str, rule: Rule) -> None:
    """Add a user rule that ``build_edges`` runs after its own."""
    _EXTRA_RULES[name] = rule


def unregister_rule(name: str) -> None:
    _EXTRA_RULES.pop(name, None)


def has_user_rules() -> bool:
    return bool(_EXTRA_RULES)


def build_edges(symbols: DataFrame, callsites: DataFrame, refs: DataFrame, *, attribute: bool = True, calls: bool = True) -> DataFrame:
    """All edges of the repositories in the inputs; without ``calls`` those that ``call_ends`` stands for are left to it.

    Calls, containment, imports and references depend on nothing; IMPLEMENTS of
    Go needs CONTAINS; OVERRIDES needs CONTAINS, IMPLEMENTS and EXTENDS.
    """
    if attribute:
        callsites = materialize(attribute_callers(callsites, symbols), "callsites")
    structure = materialize(structural_edges(symbols), "structure")
    hierarchy = materialize(
        implements_go_edges(symbols, structure)
        .unionByName(implements_java_edges(symbols, refs))
        .unionByName(extends_edges(symbols, refs)),
        "hierarchy",
    )
    outputs = [
        structure,
        hierarchy,
        import_edges(symbols, refs),
        override_edges(symbols, structure.unionByName(hierarchy)),
        reference_fqn_edges(symbols, refs),
        reference_suffix_edges(symbols, refs),
    ]
    if not has_user_rules():  # calls are distinct, and no other rule makes any
        return union_rules(outputs).unionByName(call_edges(symbols, callsites)) if calls else union_rules(outputs)
    outputs += [rule(symbols, callsites, refs) for rule in _EXTRA_RULES.values()]
    return union_rules([call_edges(symbols, callsites), *outputs] if calls else outputs)
