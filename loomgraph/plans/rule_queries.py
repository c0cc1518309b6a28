"""Edge derivation, span and semantic-upgrade queries over the code graph fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import edges as edge_ops
from loomgraph.operators import plugin, resolve, rules, spans
from loomgraph.operators.edges import as_edges
from loomgraph.plans.registry import Tables, query
from loomgraph.session import materialize

KEY = ("kind", "src", "dst")

# --- containment ------------------------------------------------------------------

#: Rule -> SQL condition on parent p and child c.
PARENT_SQL = {
    "declares_go": "p.lang = 'go' AND p.kind = 'package' AND c.kind NOT IN ('package', 'method', 'field', 'constructor') "
                   "AND c.fqn = p.fqn || '.' || c.name AND c.id <> p.id",
    "declares_java": "p.lang = 'java' AND p.kind = 'package' AND c.kind NOT IN ('package', 'method', 'field', 'constructor') "
                     "AND c.fqn = p.fqn || '.' || c.name AND c.id <> p.id",
    "contains_go_method": "c.lang = 'go' AND c.kind = 'method' AND p.kind IN ('type', 'interface') AND contains(c.fqn, '.(') "
                          "AND p.fqn = regexp_replace(c.fqn, '^(.*?)[.][(](.*?)[)][.].*$', '\\1.\\2')",
    "contains_go_member": "c.lang = 'go' AND c.kind IN ('method', 'field') AND p.kind IN ('type', 'interface') AND NOT contains(c.fqn, '.(') "
                          "AND NOT contains(c.fqn, '#') AND p.fqn = left(c.fqn, length(c.fqn) - length(c.name) - 1)",
    "contains_go_package": "p.lang = 'go' AND p.kind = 'package' AND c.kind IN ('type', 'interface') AND c.fqn = p.fqn || '.' || c.name AND c.id <> p.id",
    "contains_java_field": "c.lang = 'java' AND c.kind = 'field' AND p.kind IN ('class', 'interface', 'enum') AND NOT contains(c.fqn, '#') "
                           "AND p.fqn = left(c.fqn, length(c.fqn) - length(c.name) - 1)",
    "contains_java_method": "c.lang = 'java' AND c.kind IN ('method', 'constructor') AND p.kind IN ('class', 'interface', 'enum') "
                            "AND contains(c.fqn, '#') AND p.fqn = split_part(c.fqn, '#', 1)",
    "contains_java_package": "p.lang = 'java' AND p.kind = 'package' AND c.kind IN ('class', 'interface', 'enum') "
                             "AND c.fqn = p.fqn || '.' || c.name AND c.id <> p.id",
    "contains_javascript": "c.lang = 'javascript' AND c.kind IN ('method', 'function') AND p.kind = 'class' AND c.fqn = p.fqn || '.' || c.name",
    "contains_typescript": "c.lang = 'typescript' AND c.fqn = p.fqn || '.' || c.name AND "
                           "((c.kind IN ('method', 'function', 'arrow_function') AND p.kind IN ('class', 'function', 'arrow_function')) "
                           "OR (c.kind = 'enum_member' AND p.kind = 'enum'))",
}


def parent_sql(rule: str) -> str:
    edge = "DECLARES" if rule.startswith("declares") else "CONTAINS"
    return (
        f"SELECT DISTINCT '{edge}' AS kind, p.id AS src, c.id AS dst FROM {{code_symbols}} c JOIN {{code_symbols}} p "
        f"ON p.repo_id = c.repo_id WHERE {PARENT_SQL[rule]}"
    )


def _structural(rule: str):
    def plan(t: Tables) -> DataFrame:
        return rules.structural_edges(t.stored("code_symbols"), [rule]).select(*KEY)

    return plan


for _rule in rules.PARENT_RULES:
    query(_rule, parent_sql(_rule))(_structural(_rule))

ALL_STRUCTURE = " UNION ".join(f"({parent_sql(r)})" for r in rules.PARENT_RULES)


@query("structural_edges", f"SELECT kind, src, dst FROM ({ALL_STRUCTURE}) x")
def structural_edges(t: Tables) -> DataFrame:
    return rules.structural_edges(t.stored("code_symbols")).select(*KEY)


# --- calls --------------------------------------------------------------------------

CALLEE = "regexp_replace(k.callee_text, '^[^.]*[.]', '')"


def call_sql(lang: str, same_lang: bool = False) -> str:
    kinds = ", ".join(f"'{k}'" for k in rules.CALLEE_KINDS[lang])
    speaker = f"JOIN {{code_symbols}} a ON a.id = k.caller AND a.lang = '{lang}' " if same_lang else ""
    return (
        f"SELECT DISTINCT 'CALLS' AS kind, k.caller AS src, s.id AS dst FROM {{code_callsites}} k {speaker}"
        f"JOIN {{code_symbols}} s ON s.repo_id = k.repo_id AND s.name = {CALLEE} "
        f"WHERE k.caller IS NOT NULL AND s.lang = '{lang}' AND s.kind IN ({kinds})"
    )


def _calls(lang: str, same_lang: bool):
    def plan(t: Tables) -> DataFrame:
        return rules.call_edges(t.stored("code_symbols"), t.code_callsites, [lang], same_lang=same_lang).select(*KEY)

    return plan


for _lang in rules.CALLEE_KINDS:
    query(f"calls_{_lang}", call_sql(_lang))(_calls(_lang, False))
for _lang in ("javascript", "typescript"):
    query(f"calls_{_lang}_bulk", call_sql(_lang, True))(_calls(_lang, True))


# --- implements, imports, extends, overrides, references -----------------------------

@query(
    "implements_go",
    """
    WITH m AS (SELECT DISTINCT c.src AS owner, s.name FROM {division_contains} c JOIN {division_symbols} s ON s.id = c.dst AND s.kind = 'method'),
    need AS (SELECT owner, count(*) AS n FROM m GROUP BY owner)
    SELECT 'IMPLEMENTS' AS kind, t.id AS src, i.id AS dst
    FROM {division_symbols} i JOIN need ON need.owner = i.id JOIN m im ON im.owner = i.id JOIN m tm ON tm.name = im.name
    JOIN {division_symbols} t ON t.id = tm.owner AND t.kind = 'type' AND t.repo_id = i.repo_id AND t.id <> i.id
    WHERE i.kind = 'interface' GROUP BY t.id, i.id, need.n HAVING count(*) = need.n
    """,
)
def implements_go(t: Tables) -> DataFrame:
    return rules.implements_go_edges(t.division_symbols, t.division_contains).select(*KEY)


IMPLEMENTS_JAVA = (
    "SELECT DISTINCT 'IMPLEMENTS' AS kind, r.src, i.id AS dst FROM {code_refs} r JOIN {code_symbols} i ON i.repo_id = r.repo_id "
    "AND i.lang = 'java' AND i.kind = 'interface' AND i.name = r.ref_text WHERE r.provenance = 'implements-heuristic'"
)
EXTENDS_JAVA = (
    "SELECT DISTINCT 'EXTENDS' AS kind, r.src, i.id AS dst FROM {code_refs} r JOIN {code_symbols} i ON i.repo_id = r.repo_id "
    "AND i.lang = 'java' AND i.kind IN ('class', 'interface') AND i.name = r.ref_text WHERE r.provenance = 'extends-heuristic'"
)


@query("implements_java", IMPLEMENTS_JAVA)
def implements_java(t: Tables) -> DataFrame:
    return rules.implements_java_edges(t.stored("code_symbols"), t.code_refs).select(*KEY)


@query("extends_java", EXTENDS_JAVA)
def extends_java(t: Tables) -> DataFrame:
    return rules.extends_edges(t.stored("code_symbols"), t.code_refs).select(*KEY)


def import_sql(langs: str) -> str:
    return (
        "SELECT DISTINCT 'IMPORTS' AS kind, r.src, p.id AS dst FROM {code_refs} r JOIN {code_symbols} p ON p.repo_id = r.repo_id "
        f"AND p.kind = 'package' AND p.fqn = r.ref_text AND p.lang IN ({langs}) WHERE r.provenance = 'extractor'"
    )


@query("imports_go", import_sql("'go'"))
def imports_go(t: Tables) -> DataFrame:
    return rules.import_edges(t.stored("code_symbols"), t.code_refs, ["go"]).select(*KEY)


@query("imports_java", import_sql("'java'"))
def imports_java(t: Tables) -> DataFrame:
    return rules.import_edges(t.stored("code_symbols"), t.code_refs, ["java"]).select(*KEY)


def override_sql(contains: str, hierarchy: str) -> str:
    return (
        f"SELECT DISTINCT 'OVERRIDES' AS kind, s1.id AS src, s2.id AS dst FROM ({hierarchy}) h "
        "JOIN {code_symbols} a ON a.id = h.src AND a.kind IN ('class', 'interface') "
        "JOIN {code_symbols} b ON b.id = h.dst AND b.kind IN ('class', 'interface') "
        f"JOIN ({contains}) c1 ON c1.src = a.id JOIN {{code_symbols}} s1 ON s1.id = c1.dst AND s1.kind = 'method' AND s1.lang = 'java' "
        f"JOIN ({contains}) c2 ON c2.src = b.id JOIN {{code_symbols}} s2 ON s2.id = c2.dst AND s2.kind = 'method' AND s2.name = s1.name "
        "WHERE s1.id <> s2.id"
    )


OVERRIDES_JAVA = override_sql(parent_sql("contains_java_method"), f"({IMPLEMENTS_JAVA}) UNION ({EXTENDS_JAVA})")


@query("overrides_java", OVERRIDES_JAVA)
def overrides_java(t: Tables) -> DataFrame:
    symbols, refs = t.stored("code_symbols"), t.stored("code_refs")
    hierarchy = (
        rules.structural_edges(symbols, ["contains_java_method"])
        .unionByName(rules.implements_java_edges(symbols, refs))
        .unionByName(rules.extends_edges(symbols, refs))
    )
    return rules.override_edges(symbols, hierarchy).select(*KEY)


def reference_fqn_sql(lang: str) -> str:
    return (
        "SELECT DISTINCT 'REFERENCES' AS kind, r.src, d.id AS dst FROM {code_refs} r "
        f"JOIN {{code_symbols}} s ON s.id = r.src AND s.lang = '{lang}' JOIN {{code_symbols}} d ON d.repo_id = r.repo_id AND d.fqn = r.ref_text "
        "WHERE r.provenance = 'type-ref' AND r.src <> d.id"
    )


def reference_suffix_sql(lang: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in rules.SUFFIX_KINDS[lang])
    return (
        "SELECT DISTINCT 'REFERENCES' AS kind, r.src, d.id AS dst FROM {code_refs} r "
        f"JOIN {{code_symbols}} s ON s.id = r.src AND s.lang = '{lang}' JOIN {{code_symbols}} d ON d.repo_id = r.repo_id "
        f"AND d.lang = '{lang}' AND d.kind IN ({kinds}) AND (d.fqn = r.ref_text OR lower(right(d.fqn, length(r.ref_text) + 1)) = '.' || lower(r.ref_text)) "
        "WHERE r.provenance = 'type-ref' AND r.src <> d.id"
    )


def _reference(rule, lang: str):
    def plan(t: Tables) -> DataFrame:
        return rule(t.stored("code_symbols"), t.code_refs, [lang]).select(*KEY)

    return plan


for _lang in ("go", "java"):
    query(f"references_{_lang}", reference_fqn_sql(_lang))(_reference(rules.reference_fqn_edges, _lang))
for _lang in ("javascript", "typescript"):
    query(f"references_{_lang}", reference_suffix_sql(_lang))(_reference(rules.reference_suffix_edges, _lang))


# --- the whole build -----------------------------------------------------------------

IMPLEMENTS_GO_CODE = """
    WITH m AS (SELECT DISTINCT c.src AS owner, s.name FROM ({structure}) c JOIN @code_symbols@ s ON s.id = c.dst AND s.kind = 'method' WHERE c.kind = 'CONTAINS'),
    need AS (SELECT owner, count(*) AS n FROM m GROUP BY owner)
    SELECT 'IMPLEMENTS' AS kind, t.id AS src, i.id AS dst
    FROM @code_symbols@ i JOIN need ON need.owner = i.id JOIN m im ON im.owner = i.id JOIN m tm ON tm.name = im.name
    JOIN @code_symbols@ t ON t.id = tm.owner AND t.kind = 'type' AND t.lang = 'go' AND t.repo_id = i.repo_id AND t.id <> i.id
    WHERE i.kind = 'interface' GROUP BY t.id, i.id, need.n HAVING count(*) = need.n
""".replace("{structure}", ALL_STRUCTURE).replace("@code_symbols@", "{code_symbols}")

BUILD = " UNION ".join(
    f"(SELECT kind, src, dst FROM ({sql}) x)"
    for sql in [
        ALL_STRUCTURE, IMPLEMENTS_GO_CODE, *[call_sql(x) for x in rules.CALLEE_KINDS], IMPLEMENTS_JAVA, EXTENDS_JAVA,
        import_sql("'go', 'java'"), OVERRIDES_JAVA, reference_fqn_sql("go"), reference_fqn_sql("java"),
        reference_suffix_sql("javascript"), reference_suffix_sql("typescript"),
    ]
)


@query("build_edges", BUILD)
def build_edges(t: Tables) -> DataFrame:
    symbols, callsites, refs = t.stored("code_symbols"), t.stored("code_callsites"), t.stored("code_refs")
    return rules.build_edges(symbols, callsites, refs, attribute=False).select(*KEY)


@query(
    "edge_families",
    "SELECT kind, CASE kind WHEN 'CALLS' THEN 'treesitter' WHEN 'IMPORTS' THEN 'extractor' WHEN 'CONTAINS' THEN 'extractor' WHEN 'DECLARES' THEN 'extractor' "
    "ELSE 'heuristic' END AS provenance, CAST(CASE kind WHEN 'CALLS' THEN 0.4 WHEN 'REFERENCES' THEN 0.4 WHEN 'IMPORTS' THEN 0.8 WHEN 'CONTAINS' THEN 1.0 "
    f"WHEN 'DECLARES' THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence, count(*) AS n FROM ({BUILD}) b GROUP BY kind",
)
def edge_families(t: Tables) -> DataFrame:
    symbols, callsites, refs = t.stored("code_symbols"), t.stored("code_callsites"), t.stored("code_refs")
    built = rules.build_edges(symbols, callsites, refs, attribute=False)
    return built.groupBy("kind", "provenance", "confidence").agg(F.count(F.lit(1)).alias("n"))


# --- binding of extracted names --------------------------------------------------------

NAMED = (
    "SELECT r.repo_id, r.src AS file_id, s.fqn || CASE WHEN r.src % 3 = 0 THEN '' ELSE '' END AS src_fqn, r.ref_text, r.provenance "
    "FROM {code_refs} r JOIN {code_symbols} s ON s.id = r.src"
)


def _named(t: Tables, provenance: str) -> DataFrame:
    symbols = t.stored("code_symbols").select(F.col("id").alias("src"), F.col("fqn").alias("src_fqn"))
    return t.code_refs.where(F.col("provenance") == provenance).join(symbols, "src").select(
        "repo_id", F.col("src").alias("file_id"), "src_fqn", "ref_text"
    )


def bind_sql(provenance: str, condition: str) -> str:
    return (
        f"WITH named AS ({NAMED}) SELECT n.file_id, b.src, n.ref_text FROM named n JOIN (SELECT repo_id, fqn, min(id) AS src FROM {{code_symbols}} "
        f"WHERE {condition} GROUP BY 1, 2) b ON b.repo_id = n.repo_id AND b.fqn = n.src_fqn WHERE n.provenance = '{provenance}'"
    )


def _bind(rule, provenance: str):
    def plan(t: Tables) -> DataFrame:
        return rule(t.stored("code_symbols"), _named(t, provenance)).select("file_id", "src", "ref_text")

    return plan


for _name, _bound, _provenance, _condition in (
    ("bind_imports", rules.bind_imports, "extractor", "kind = 'package'"),
    ("bind_extends", rules.bind_extends, "extends-heuristic", "lang = 'java'"),
    ("bind_implements", rules.bind_implements, "implements-heuristic", "lang = 'java'"),
    ("bind_type_refs", rules.bind_type_refs, "type-ref", "true"),
):
    query(_name, bind_sql(_provenance, _condition))(_bind(_bound, _provenance))


# --- spans ------------------------------------------------------------------------------

ENCLOSING = (
    "SELECT k.id, min(s.id) FILTER (s.len = b.len) AS found FROM {span_callsites} k "
    "JOIN (SELECT *, end_byte - start_byte AS len FROM {span_symbols}) s ON s.file_id = k.file_id AND s.start_byte <= k.start_byte AND s.end_byte >= k.end_byte "
    "JOIN (SELECT k2.id, min(s2.end_byte - s2.start_byte) AS len FROM {span_callsites} k2 JOIN {span_symbols} s2 "
    "ON s2.file_id = k2.file_id AND s2.start_byte <= k2.start_byte AND s2.end_byte >= k2.end_byte GROUP BY k2.id) b ON b.id = k.id GROUP BY k.id"
)


@query(
    "caller_attribution",
    f"SELECT k.id, f.found AS caller FROM {{span_callsites}} k LEFT JOIN ({ENCLOSING}) f ON f.id = k.id",
)
def caller_attribution(t: Tables) -> DataFrame:
    return spans.attribute_callers(t.span_callsites, t.span_symbols).select("id", "caller")


def _located_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Call sites as locations; symbols with lines in place of bytes; their files."""
    symbols = t.span_symbols.withColumns({"start_line": F.col("start_byte"), "end_line": F.col("end_byte")})
    files = t.span_files
    places = t.span_callsites.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return symbols, files, places


AT_LINE = ENCLOSING.replace("k.end_byte", "k.start_byte").replace("k2.end_byte", "k2.start_byte")


@query("location_to_symbol", f"SELECT id AS loc_id, found AS symbol_id FROM ({AT_LINE}) x")
def location_to_symbol(t: Tables) -> DataFrame:
    symbols, files, places = _located_inputs(t)
    return spans.locate_symbols(
        places.select(F.col("id").alias("loc_id"), "repo_id", "path", F.col("start_byte").alias("line")), symbols, files
    )


# Without the spans around whole files many locations lie outside any symbol.
INNER = AT_LINE.replace("{span_symbols} s2", "(SELECT * FROM {span_symbols} WHERE kind = 'function') s2").replace(
    "FROM {span_symbols}) s ON", "FROM {span_symbols} WHERE kind = 'function') s ON"
)
LOCATE_OR_MATCH = (
    f"WITH hit AS ({INNER}) SELECT id AS loc_id, found AS symbol_id, 'location' AS how FROM hit UNION ALL "
    "SELECT k.id, min(s.id), 'name' FROM {span_callsites} k JOIN {span_symbols} s ON s.kind = 'function' AND s.repo_id = k.repo_id AND "
    "contains(lower(s.name), lower(split_part(k.callee_text, '.', -1))) WHERE k.id NOT IN (SELECT id FROM hit) GROUP BY k.id"
)


def _inner_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    symbols, files, places = _located_inputs(t)
    return symbols.where("kind = 'function'"), files, places


@query("location_or_name", LOCATE_OR_MATCH)
def location_or_name(t: Tables) -> DataFrame:
    symbols, files, places = _inner_inputs(t)
    wanted = places.select(
        F.col("id").alias("loc_id"), "repo_id", "path", F.col("start_byte").alias("line"), "callee_text"
    )
    return spans.locate_or_match(wanted, symbols, files)


# --- semantic upgrade --------------------------------------------------------------------

@query(
    "semantic_calls",
    f"WITH found AS ({LOCATE_OR_MATCH}) SELECT DISTINCT 'CALLS' AS kind, k.file_id AS src, f.symbol_id AS dst, CAST(1 AS DOUBLE) AS confidence, 'gopls' AS provenance "
    "FROM found f JOIN {span_callsites} k ON k.id = f.loc_id",
)
def semantic_calls(t: Tables) -> DataFrame:
    symbols, files, places = _inner_inputs(t)
    definitions = places.select(F.col("id").alias("callsite_id"), "path", F.col("start_byte").alias("line"))
    calls = t.span_callsites.withColumn("caller", F.col("file_id"))
    return resolve.resolve_callsites(calls, definitions, symbols, files, "gopls")[1].drop("repo_id")


@query(
    "resolved_callsites",
    f"WITH found AS ({LOCATE_OR_MATCH}) SELECT k.id, f.symbol_id AS resolved FROM {{span_callsites}} k LEFT JOIN found f ON f.loc_id = k.id",
)
def resolved_callsites(t: Tables) -> DataFrame:
    symbols, files, places = _inner_inputs(t)
    definitions = places.select(F.col("id").alias("callsite_id"), "path", F.col("start_byte").alias("line"))
    return resolve.resolve_callsites(t.span_callsites, definitions, symbols, files, "gopls")[0].select("id", "resolved")


def _answers(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each span symbol asks about a line fifty further on in its own file."""
    symbols, files, _ = _located_inputs(t)
    asked = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(
        F.col("id").alias("symbol_id"), "path", (F.col("start_byte") + 50).alias("line"),
        F.when(F.col("id") % 2 == 0, 11).otherwise(5).alias("parent_kind"),
    )
    return asked, symbols.withColumn("kind", F.when(F.col("id") % 3 == 0, "class").otherwise("interface")), files


LOCATED = (
    "WITH q AS (SELECT id, file_id, start_byte + 50 AS line FROM {span_symbols}), "
    "c AS (SELECT q.id, s.id AS hit, s.end_byte - s.start_byte AS len FROM q JOIN {span_symbols} s ON s.file_id = q.file_id "
    "AND s.start_byte <= q.line AND s.end_byte >= q.line), "
    "found AS (SELECT id, arg_min(hit, struct_pack(len := len, hit := hit)) AS hit FROM c GROUP BY id) "
)


@query(
    "semantic_overrides",
    LOCATED + "SELECT 'OVERRIDES' AS kind, hit AS src, id AS dst, CAST(1 AS DOUBLE) AS confidence, 'jdtls' AS provenance FROM found",
)
def semantic_overrides(t: Tables) -> DataFrame:
    asked, symbols, files = _answers(t)
    return resolve.implementation_edges(asked, symbols, files, "jdtls").drop("repo_id")


@query(
    "semantic_hierarchy",
    LOCATED + "SELECT CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'IMPLEMENTS' ELSE 'EXTENDS' END AS kind, id AS src, hit AS dst, "
    "CAST(1 AS DOUBLE) AS confidence, 'jdtls' AS provenance FROM found",
)
def semantic_hierarchy(t: Tables) -> DataFrame:
    asked, symbols, files = _answers(t)
    return resolve.hierarchy_edges(asked, symbols, files, "jdtls").drop("repo_id")


@query(
    "symbol_worklist",
    "SELECT s.id, s.file_id, s.start_byte AS start_line, f.path, s.kind FROM {span_symbols} s JOIN {span_files} f ON f.id = s.file_id "
    "WHERE s.id % 7 > 0 ORDER BY f.path, s.start_byte, s.id LIMIT 1000",
)
def symbol_worklist(t: Tables) -> DataFrame:
    symbols, files, _ = _located_inputs(t)
    return resolve.worklist(
        symbols.withColumn("start_col", F.col("id") % 7), files, ["function", "method"]
    ).drop("start_col")


# --- edge table maintenance ----------------------------------------------------------------

ORDER = ("ord1", "ord2", "ord3", "ord4", "provenance")


@query(
    "edge_first_wins",
    "SELECT kind, src, dst, confidence, provenance FROM (SELECT *, row_number() OVER (PARTITION BY kind, src, dst "
    "ORDER BY ord1, ord2, ord3, ord4, confidence, provenance) AS n FROM {edge_writes}) x WHERE n = 1",
)
def edge_first_wins(t: Tables) -> DataFrame:
    return edge_ops.first_wins(t.edge_writes, ORDER[:4]).drop("repo_id")


@query(
    "edge_insert_or_ignore",
    "WITH old AS (SELECT kind, src, dst, min(confidence) AS confidence, 'old' AS provenance FROM {edge_writes} WHERE starts_with(provenance, 'rR') GROUP BY 1, 2, 3), "
    "fresh AS (SELECT kind, src, dst, max(confidence) AS confidence, 'new' AS provenance FROM {edge_writes} GROUP BY 1, 2, 3) "
    "SELECT * FROM old UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.src = f.src AND o.dst = f.dst AND o.kind = f.kind)",
)
def edge_insert_or_ignore(t: Tables) -> DataFrame:
    writes = t.edge_writes
    key = ["repo_id", "kind", "src", "dst"]
    old = writes.where("startswith(provenance, 'rR')").groupBy(*key).agg(F.min("confidence").alias("confidence"), F.lit("old").alias("provenance"))
    fresh = writes.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.lit("new").alias("provenance"))
    return edge_ops.insert_or_ignore(old, fresh).drop("repo_id")


@query(
    "edge_strict_insert",
    "SELECT kind, src, dst FROM {trade_edges} UNION ALL SELECT 'EXTENDS', src, dst FROM {trade_edges} WHERE kind = 'IMPLEMENTS'",
)
def edge_strict_insert(t: Tables) -> DataFrame:
    edges = t.stored("trade_edges")
    more = edges.where("kind = 'IMPLEMENTS'").withColumn("kind", F.lit("EXTENDS"))
    return edge_ops.strict_insert(edges, more).select(*KEY)


@query(
    "semantic_upgrade",
    "WITH old AS (SELECT kind, src, dst, CAST(0.05 AS DOUBLE) AS confidence, 'treesitter' AS provenance FROM {edge_writes} GROUP BY 1, 2, 3), "
    "best AS (SELECT kind, src, dst, confidence, provenance FROM (SELECT *, row_number() OVER (PARTITION BY kind, src, dst "
    "ORDER BY confidence DESC, ord1 * 8 + ord2, provenance) AS n FROM {edge_writes}) x WHERE n = 1) "
    "SELECT o.kind, o.src, o.dst, greatest(o.confidence, b.confidence) AS confidence, "
    "CASE WHEN b.confidence > o.confidence THEN b.provenance ELSE o.provenance END AS provenance FROM old o JOIN best b ON b.kind = o.kind AND b.src = o.src AND b.dst = o.dst",
)
def semantic_upgrade(t: Tables) -> DataFrame:
    writes = t.edge_writes.withColumn("seq", F.col("ord1") * 8 + F.col("ord2"))
    old = writes.select("repo_id", "kind", "src", "dst").distinct().withColumns(
        {"confidence": F.lit(0.05), "provenance": F.lit("treesitter")}
    )
    return edge_ops.semantic_upsert(old, writes).drop("repo_id")


@query(
    "edge_rebuild",
    "WITH stale AS (SELECT e.* FROM {trade_edges} e WHERE NOT (e.kind = 'CALLS' AND EXISTS (SELECT 1 FROM {trade_symbols} s WHERE s.id = e.src AND s.lang = 'go'))) "
    "SELECT kind, src, dst FROM stale UNION SELECT 'CALLS', dst, src FROM {trade_edges} WHERE kind = 'CALLS'",
)
def edge_rebuild(t: Tables) -> DataFrame:
    edges = t.trade_edges.withColumns({"confidence": F.lit(0.4), "provenance": F.lit("treesitter")})
    turned = edges.where("kind = 'CALLS'").select(
        "repo_id", "kind", F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence", "provenance"
    )
    return edge_ops.rebuild(edges, t.trade_symbols, "CALLS", "treesitter", "go", turned).select(*KEY)


@query(
    "edge_cascade",
    "SELECT kind, src, dst FROM {trade_edges} WHERE src IN (SELECT id FROM {trade_symbols} WHERE kind <> 'interface') "
    "AND dst IN (SELECT id FROM {trade_symbols} WHERE kind <> 'interface')",
)
def edge_cascade(t: Tables) -> DataFrame:
    return edge_ops.cascade(t.trade_edges, t.trade_symbols.where("kind <> 'interface'")).select(*KEY)


@query(
    "set_null_missing",
    "SELECT e.kind, a.id AS src, b.id AS dst FROM {trade_edges} e LEFT JOIN {trade_symbols} a ON a.id = e.src AND a.kind <> 'interface' "
    "LEFT JOIN {trade_symbols} b ON b.id = e.dst AND b.kind <> 'interface'",
)
def set_null_missing(t: Tables) -> DataFrame:
    alive = t.trade_symbols.where("kind <> 'interface'")
    return edge_ops.set_null_missing(t.trade_edges, ["src", "dst"], alive).select(*KEY)


# --- user code ------------------------------------------------------------------------

@query(
    "user_rule",
    "SELECT 'SIBLING' AS kind, CAST(s_suppkey * 4 + 2 AS BIGINT) AS src, CAST(s_nationkey * 4 + 3 AS BIGINT) AS dst, CAST(0.3 AS DOUBLE) AS confidence, 'user' AS provenance FROM {supplier}",
)
def user_rule(t: Tables) -> DataFrame:
    """A rule that a user registers, run by the build after its own rules."""
    symbols = t.stored("trade_symbols")
    homes = t.supplier.select((F.col("s_suppkey") * 4 + 2).cast("long").alias("src"), (F.col("s_nationkey") * 4 + 3).cast("long").alias("dst"))

    def siblings(symbols: DataFrame, callsites: DataFrame, refs: DataFrame) -> DataFrame:
        methods = symbols.where("kind = 'method'").select("repo_id", F.col("id").alias("src"))
        return as_edges(methods.join(homes, "src"), "SIBLING", 0.3, "user")

    rules.register_rule("siblings", siblings)
    try:
        edges = rules.build_edges(symbols, t.code_callsites.where("false"), t.code_refs.where("false"), attribute=False)
        return materialize(edges, "user-edges").where("kind = 'SIBLING'").select("kind", "src", "dst", "confidence", "provenance")
    finally:
        rules.unregister_rule("siblings")


@query(
    "user_resolver",
    "SELECT o_orderkey AS id, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 1000 THEN CAST(l.least AS BIGINT) END AS resolved FROM {orders} "
    "LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS least FROM {lineitem} GROUP BY 1) l ON l_orderkey = o_orderkey",
)
def user_resolver(t: Tables) -> DataFrame:
    """Call sites that a user's resolver answers with places, a work list at a time: orders as calls, suppliers as symbols of their nation's file."""
    repo = F.lit(1).cast("long").alias("repo_id")
    path = F.concat(F.lit("n"), "n_nationkey", F.lit(".go")).alias("path")
    files = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), repo, path)
    line = (F.col("s_suppkey") * 10 + 1).cast("int")
    symbols = t.supplier.select(
        F.col("s_suppkey").cast("long").alias("id"), repo, F.col("s_nationkey").cast("long").alias("file_id"),
        F.col("s_name").alias("name"), line.alias("start_line"), (line + 5).cast("int").alias("end_line"),
    )
    calls = t.orders.select(
        F.col("o_orderkey").cast("long").alias("id"), repo, F.col("o_custkey").cast("long").alias("caller"),
        F.lit("x.unknown").alias("callee_text"), F.lit(None).cast("long").alias("resolved"),
    )
    sold = t.lineitem.groupBy(F.col("l_orderkey").cast("long").alias("callsite_id")).agg(F.min("l_suppkey").alias("s_suppkey"))
    places = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", path, (line + 2).cast("int").alias("line"))

    def resolver(work: DataFrame) -> DataFrame:
        asked = sold.join(work.select(F.col("id").alias("callsite_id")), "callsite_id", "left_semi")
        return asked.join(places, "s_suppkey").select("callsite_id", "path", "line")

    after, _ = resolve.run_resolver(resolver, calls, symbols, files, "server")
    return after.select("id", "resolved")


@query("row_callback", "SELECT count(*) AS called, CAST(sum(event_id) AS BIGINT) AS total FROM {events}")
def row_callback(t: Tables) -> DataFrame:
    """A user's callback for every row, inside the tasks that hold the rows."""
    context = t.spark.sparkContext
    called, total = context.accumulator(0), context.accumulator(0)

    def callback(row) -> None:
        called.add(1)
        total.add(row.event_id)

    plugin.for_each_row(t.events.select("event_id"), callback)
    return t.spark.createDataFrame([(called.value, total.value)], "called long, total long")
