"""Incremental maintenance, file discovery and scalar function queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import names, paths, text
from loomgraph.operators import incremental as inc
from loomgraph.operators import lookup, typerefs
from loomgraph.operators import search as search_ops
from loomgraph.plans.registry import Tables, query
from loomgraph.session import materialize, scratch_root
from loomgraph.sources import files as file_ops

# --- change detection ---------------------------------------------------------------

STATUS = (
    "SELECT a.path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.sha256 = b.sha256 AND a.mtime = b.mtime THEN 'unchanged' ELSE 'changed' END AS status "
    "FROM {snapshot_after} a LEFT JOIN {snapshot_before} b ON b.repo_id = a.repo_id AND b.path = a.path"
)


@query("change_detect", STATUS)
def change_detect(t: Tables) -> DataFrame:
    return inc.change_status(t.snapshot_before, t.snapshot_after).select("path", "status")


@query("change_detect_full", "SELECT path, 'new' AS status FROM {snapshot_after}")
def change_detect_full(t: Tables) -> DataFrame:
    return inc.change_status(t.snapshot_before, t.snapshot_after, full=True).select("path", "status")


@query(
    "stale_files",
    "SELECT path FROM {snapshot_before} b WHERE NOT EXISTS (SELECT 1 FROM {snapshot_after} a WHERE a.path = b.path AND a.repo_id = b.repo_id)",
)
def stale_files(t: Tables) -> DataFrame:
    return inc.stale_files(t.snapshot_before, t.snapshot_after).select("path")


def _file_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    before = t.snapshot_before.withColumns({"id": F.col("mtime"), "lang": F.lit("go")})
    after = t.snapshot_after.withColumns({"id": F.lit(-1).cast("long"), "lang": F.lit("java")})
    return before, after


@query(
    "upsert_files",
    "SELECT coalesce(b.mtime, -1) AS id, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'java' ELSE 'go' END AS lang, "
    "coalesce(a.sha256, b.sha256) AS sha256, coalesce(a.mtime, b.mtime) AS mtime "
    "FROM {snapshot_after} a FULL JOIN {snapshot_before} b ON b.path = a.path AND b.repo_id = a.repo_id",
)
def upsert_files(t: Tables) -> DataFrame:
    return inc.upsert_files(*_file_tables(t)).select("id", "path", "lang", "sha256", "mtime")


@query(
    "upsert_repos",
    "SELECT coalesce(b.mtime, a.mtime) AS id, coalesce(a.path, b.path) AS root_path, coalesce(a.sha256, b.sha256) AS name, "
    "coalesce(b.mtime, a.mtime) AS created_at, coalesce(a.mtime, b.mtime) AS updated_at "
    "FROM {snapshot_after} a FULL JOIN {snapshot_before} b ON b.path = a.path",
)
def upsert_repos(t: Tables) -> DataFrame:
    def repos(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("mtime").alias("id"), F.col("path").alias("root_path"), F.col("sha256").alias("name"),
            F.col("mtime").alias("created_at"), F.col("mtime").alias("updated_at"),
        )

    return inc.upsert_repos(repos(t.snapshot_before), repos(t.snapshot_after))


@query(
    "upsert_symbols",
    "WITH w AS (SELECT src AS repo_id, 'k' || CAST(dst % 3 AS VARCHAR) AS kind, 'f' || CAST(dst AS VARCHAR) AS fqn, ord1, ord2, ord3, ord4, provenance AS name FROM {edge_writes}), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, kind, fqn ORDER BY ord1, ord2, ord3, ord4) AS n, "
    "row_number() OVER (PARTITION BY repo_id, kind, fqn ORDER BY ord1 DESC, ord2 DESC, ord3 DESC, ord4 DESC) AS back FROM w) "
    "SELECT a.repo_id, a.kind, a.fqn, a.ord1 AS id, b.name FROM r a JOIN r b ON b.repo_id = a.repo_id AND b.kind = a.kind AND b.fqn = a.fqn WHERE a.n = 1 AND b.back = 1",
)
def upsert_symbols(t: Tables) -> DataFrame:
    writes = t.edge_writes.select(
        F.col("src").alias("repo_id"), F.concat(F.lit("k"), F.col("dst") % 3).alias("kind"),
        F.concat(F.lit("f"), "dst").alias("fqn"), F.col("ord1").alias("id"), F.col("provenance").alias("name"),
        "ord1", "ord2", "ord3", "ord4",
    )
    empty = writes.select("repo_id", "kind", "fqn", "id", "name").where("false")
    return inc.upsert_symbols(empty, writes, ["ord1", "ord2", "ord3", "ord4"])


@query(
    "replace_by_file",
    "SELECT id, file_id, 'old' AS version FROM {span_callsites} WHERE file_id NOT IN (SELECT file_id FROM {span_callsites} WHERE callee_text = 'view.h7') "
    "UNION ALL SELECT id, file_id, 'new' FROM {span_callsites} WHERE callee_text = 'view.h7'",
)
def replace_by_file(t: Tables) -> DataFrame:
    old = t.span_callsites.select("id", "file_id", F.lit("old").alias("version"))
    new = t.span_callsites.where("callee_text = 'view.h7'").select("id", "file_id", F.lit("new").alias("version"))
    return inc.replace_by_file(old, new, new)


def _repo_tables(t: Tables) -> dict[str, DataFrame]:
    """Files are nations; customers, suppliers and parts are their symbols."""
    symbols = t.trade_symbols.join(
        t.customer.select((F.col("c_custkey") * 4).alias("id"), F.col("c_nationkey").cast("long").alias("file_id")), "id"
    )
    calls = t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 25).alias("file_id"), F.lit(1).cast("long").alias("repo_id"),
        (F.col("o_custkey") * 4).alias("caller"), (F.col("o_orderkey") % 1500 * 4).alias("resolved"),
    )
    refs = calls.select("repo_id", "file_id", F.col("caller").alias("src"), F.col("resolved").alias("dst"))
    edges = calls.select("repo_id", F.lit("CALLS").alias("kind"), F.col("caller").alias("src"), F.col("resolved").alias("dst")).distinct()
    files = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.lit(1).cast("long").alias("repo_id"))
    return {"files": files, "symbols": symbols, "callsites": calls, "refs": refs, "edges": edges}


GONE = "(SELECT c_custkey * 4 AS id FROM {customer} WHERE c_nationkey < 3)"
ALIVE = "(SELECT c_custkey * 4 AS id FROM {customer} WHERE c_nationkey >= 3)"


@query(
    "delete_files",
    f"WITH alive AS {ALIVE} "
    "SELECT 'files' AS part, count(*) AS n, CAST(0 AS BIGINT) AS linked FROM {nation} WHERE n_nationkey >= 3 UNION ALL "
    "SELECT 'symbols', count(*), CAST(0 AS BIGINT) FROM alive UNION ALL "
    "SELECT 'callsites', count(*), count(a.id) + count(b.id) FROM {orders} LEFT JOIN alive a ON a.id = o_custkey * 4 LEFT JOIN alive b ON b.id = o_orderkey % 1500 * 4 WHERE o_orderkey % 25 >= 3 UNION ALL "
    "SELECT 'refs', count(*), count(a.id) + count(b.id) FROM {orders} LEFT JOIN alive a ON a.id = o_custkey * 4 LEFT JOIN alive b ON b.id = o_orderkey % 1500 * 4 WHERE o_orderkey % 25 >= 3 UNION ALL "
    "SELECT 'edges', count(*), CAST(0 AS BIGINT) FROM (SELECT DISTINCT o_custkey * 4 AS s, o_orderkey % 1500 * 4 AS d FROM {orders}) e WHERE s IN (SELECT id FROM alive) AND d IN (SELECT id FROM alive)",
)
def delete_files(t: Tables) -> DataFrame:
    tables = _repo_tables(t)
    after = inc.delete_files(tables, tables["files"].where("id < 3"))
    links = {"callsites": ("caller", "resolved"), "refs": ("src", "dst")}
    parts = []
    for name, rows in after.items():
        a, b = links.get(name, (None, None))
        linked = (F.count(a) + F.count(b)) if a else F.lit(0).cast("long")
        parts.append(rows.agg(F.count(F.lit(1)).alias("n"), linked.alias("linked")).select(F.lit(name).alias("part"), "n", "linked"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("clear_repo", "SELECT repo_id, id FROM {code_symbols} WHERE repo_id <> 3")
def clear_repo(t: Tables) -> DataFrame:
    return inc.clear_repo({"symbols": t.code_symbols}, 3)["symbols"].select("repo_id", "id")


@query(
    "run_summary",
    f"WITH s AS ({STATUS}), r AS (SELECT *, CASE WHEN path LIKE '%7' AND status <> 'unchanged' THEN 1 ELSE 0 END AS bad, length(path) AS n FROM s) "
    "SELECT count(*) FILTER (status <> 'unchanged' AND bad = 0) AS indexed, count(*) FILTER (status = 'unchanged') AS unchanged, "
    "CAST(sum(n) FILTER (status <> 'unchanged' AND bad = 0) AS BIGINT) AS symbols, CAST(2 * sum(n) FILTER (status <> 'unchanged' AND bad = 0) AS BIGINT) AS callsites, "
    "count(*) FILTER (bad = 1) AS errors FROM r",
)
def run_summary(t: Tables) -> DataFrame:
    results = inc.change_status(t.snapshot_before, t.snapshot_after).select(
        "status", F.length("path").alias("n_symbols"), (F.length("path") * 2).alias("n_callsites"),
        F.when(F.endswith("path", F.lit("7")), "read error").alias("error"),
    )
    return inc.run_summary(results)


@query("mark_resolved", "SELECT id, CASE WHEN starts_with(callee_text, 'view.h1') THEN file_id END AS resolved FROM {span_callsites}")
def mark_resolved(t: Tables) -> DataFrame:
    found = t.span_callsites.where("startswith(callee_text, 'view.h1')").select("id", F.col("file_id").alias("symbol_id"))
    return inc.mark_resolved(t.span_callsites, found).select("id", "resolved")


@query("unresolved_callsites", "SELECT id, callee_text FROM {span_callsites} WHERE resolved IS NULL ORDER BY id LIMIT 1000")
def unresolved_callsites(t: Tables) -> DataFrame:
    return inc.unresolved_callsites(t.span_callsites).select("id", "callee_text")


@query("stable_ids", "SELECT count(*) AS symbols, count(DISTINCT (repo_id, kind, fqn)) AS ids, CAST(0 AS BIGINT) AS collisions FROM {code_symbols}")
def stable_ids(t: Tables) -> DataFrame:
    rows = t.code_symbols.withColumn("start_byte", F.lit(0)).withColumn("end_byte", F.lit(0)).withColumn("id", inc.symbol_id())
    clashes = inc.id_collisions(rows, ["repo_id", "kind", "fqn"]).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("symbols"), F.count_distinct("id").alias("ids"), F.max(clashes).alias("collisions")
    )


# --- file discovery ------------------------------------------------------------------

EXT = "lower(regexp_extract(path, '([.][^./]*)$', 1))"
LANG = (
    f"CASE WHEN {EXT} = '.go' THEN 'go' WHEN {EXT} = '.java' THEN 'java' WHEN {EXT} IN ('.js', '.mjs', '.cjs', '.jsx') THEN 'javascript' "
    f"WHEN {EXT} IN ('.ts', '.tsx') THEN 'typescript' WHEN {EXT} IN ('.html', '.htm') THEN 'html' WHEN {EXT} = '.css' THEN 'css' END"
)


@query("classify_lang", f"SELECT path, {LANG} AS lang FROM {{doc_files}}")
def classify_lang(t: Tables) -> DataFrame:
    return t.doc_files.select("path", paths.classify_lang("path").alias("lang"))


@query("lang_filter", f"SELECT path, {LANG} AS lang FROM {{doc_files}} WHERE {LANG} IN ('go', 'css')")
def lang_filter(t: Tables) -> DataFrame:
    return file_ops.with_lang(t.doc_files, file_ops.parse_langs(" Go, css,")).select("path", "lang")


@query("hidden_dirs", "SELECT path FROM {doc_files} WHERE path NOT LIKE 'vendor/%' AND path NOT LIKE '.cache/%'")
def hidden_dirs(t: Tables) -> DataFrame:
    return file_ops.drop_hidden(t.doc_files).select("path")


IGNORED = (
    "path LIKE 'node_modules/%' OR path LIKE 'build/%' OR regexp_matches(path, '^src/src1[^/]*(/.*)?$') "
    "OR (path LIKE '%.min.js' AND NOT regexp_matches(path, '(^|/)d1[^/]*[.]min[.]js$'))"
)


@query("ignore_rules", f"SELECT path FROM {{doc_files}} WHERE NOT ({IGNORED})")
def ignore_rules(t: Tables) -> DataFrame:
    return file_ops.filter_ignored(t.doc_files, file_ops.ignore_rules(t.ignore_lines)).select("path")


@query(
    "discover",
    f"SELECT path, {LANG} AS lang FROM {{doc_files}} WHERE NOT ({IGNORED}) AND path NOT LIKE 'vendor/%' AND path NOT LIKE '.cache/%' AND {LANG} IS NOT NULL",
)
def discover(t: Tables) -> DataFrame:
    return file_ops.discover(t.doc_files, t.ignore_lines).select("path", "lang")


@query("content_sha256", "SELECT doc_id, sha256(text) AS sha FROM {documents}")
def content_sha256(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", file_ops.sha256_hex("text").alias("sha"))


@query(
    "go_modules",
    "SELECT DISTINCT repo_id, CASE WHEN repo_id = 3 THEN 'unknown' ELSE 'example.org/m' || CAST(repo_id AS VARCHAR) END AS module FROM {doc_files}",
)
def go_modules(t: Tables) -> DataFrame:
    mods = t.doc_files.where("repo_id < 3").select("repo_id").distinct().select(
        "repo_id", F.lit("go.mod").alias("path"),
        F.concat(F.lit("// x\n  module example.org/m"), "repo_id", F.lit(" \ngo 1.25\nmodule other")).alias("content"),
    )
    return file_ops.go_module(t.doc_files.select("repo_id", "path", "content").unionByName(mods))


TREE_PATH = (
    "CASE doc_id % 4 WHEN 0 THEN 'pkg/_lib/u' WHEN 1 THEN 'web/.conf' WHEN 2 THEN '_app' ELSE 'a/b/c/' || source END || '/' || "
    "CASE doc_id % 3 WHEN 0 THEN '_f' WHEN 1 THEN '.f' ELSE 'f' END || CAST(doc_id AS VARCHAR(20)) || '.js'"
)


def _written_tree(t: Tables) -> str:
    """Every document as a file below a new folder of the shared scratch folder."""
    root = f"{scratch_root(t.spark)}/tree-{uuid.uuid4().hex}"

    def write(batches):
        import pyarrow.fs as pafs

        store, base = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as stream:
                    stream.write(text.encode())
            yield batch[["path"]]

    t.documents.selectExpr(f"{TREE_PATH} AS path", "text").mapInPandas(write, "path string").count()
    return root


@query("scan_files", f"SELECT {TREE_PATH} AS path, octet_length(encode(text)) AS size, sha256(text) AS sha FROM {{documents}}")
def scan_files(t: Tables) -> DataFrame:
    """A tree written from the documents, with names and folders that start with an underscore or a dot."""
    return file_ops.scan_files(t.spark, _written_tree(t)).select("path", "size", file_ops.sha256_hex("content").alias("sha"))


#: Ignored folders and names of that tree; hidden folders are left out as well.
TREE_IGNORED = ("_lib/", "a/b/c/src1*", "_f*7.js", "!_f*77.js")


@query(
    "scan_sources",
    f"SELECT path, 'javascript' AS lang, sha FROM (SELECT {TREE_PATH} AS path, sha256(text) AS sha FROM {{documents}}) x WHERE path NOT LIKE 'pkg/%' AND path NOT LIKE 'web/%' "
    "AND NOT starts_with(path, 'a/b/c/src1') AND NOT (regexp_matches(path, '/_f[^/]*7[.]js$') AND NOT regexp_matches(path, '/_f[^/]*77[.]js$'))",
)
def scan_sources(t: Tables) -> DataFrame:
    """The same tree, listed without hidden and ignored folders; only sources are opened."""
    return file_ops.scan_sources(t.spark, _written_tree(t), ignore_lines=TREE_IGNORED).select("path", "lang", F.col("sha256").alias("sha"))


@query("files_of_repo", "SELECT doc_id, path FROM {doc_files} WHERE repo_id = 2")
def files_of_repo(t: Tables) -> DataFrame:
    return lookup.files_of_repo(t.doc_files, 2).select("doc_id", "path")


@query("file_by_path", "SELECT doc_id, path FROM {doc_files} WHERE repo_id = 3 AND path = 'build/out/src3/d3.mjs'")
def file_by_path(t: Tables) -> DataFrame:
    return lookup.file_by_path(t.doc_files, 3, "build/out/src3/d3.mjs").select("doc_id", "path")


@query("repo_by_path", "SELECT path AS root_path, sha256 AS name FROM {snapshot_before} WHERE path = 'doc/7'")
def repo_by_path(t: Tables) -> DataFrame:
    repos = t.snapshot_before.withColumnsRenamed({"path": "root_path", "sha256": "name"})
    return lookup.repo_by_path(repos, "doc/7").select("root_path", "name")


# --- scalar functions ------------------------------------------------------------------

@query(
    "callee_keys",
    "SELECT p_partkey, regexp_replace(x, '^[^.]*[.]', '') AS first_dot, split_part(x, '.', -1) AS last_dot "
    "FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'a.' || p_name ELSE 'a.b.' || p_type END AS x FROM {part}) t",
)
def callee_keys(t: Tables) -> DataFrame:
    x = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'a.' || p_name ELSE 'a.b.' || p_type END")
    return t.part.select(
        "p_partkey", names.callee_key(x).alias("first_dot"), names.callee_key(x, last=True).alias("last_dot")
    )


@query(
    "fqn_functions",
    "SELECT id, CASE WHEN regexp_matches(fqn, '^.*?[.][(].*?[)][.].*$') THEN regexp_replace(fqn, '^(.*?)[.][(](.*?)[)][.].*$', '\\1.\\2') END AS owner, "
    "left(fqn, length(fqn) - length(name) - 1) AS parent, split_part(fqn, '#', 1) AS hash_owner, "
    "CASE WHEN regexp_matches(name, '^\\p@<Lu>@') THEN 'public' ELSE 'private' END AS visibility, "
    "regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$') AS ident, split_part(fqn, '.', -1) AS simple FROM {code_symbols}",
)
def fqn_functions(t: Tables) -> DataFrame:
    return t.code_symbols.select(
        "id", names.receiver_owner("fqn").alias("owner"), names.parent_by_name("fqn", "name").alias("parent"),
        names.hash_owner("fqn").alias("hash_owner"), names.go_visibility("name").alias("visibility"),
        names.is_identifier("name").alias("ident"), names.simple_name("fqn").alias("simple"),
    )


JAVA_TYPE = (
    "CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN ' java.util.Map<String, List<' || p_type || '>> ' WHEN 2 THEN 'List<' || p_type || '>[][]' "
    "ELSE 'Map.Entry<K,V>, Comparable<' || p_type || '>, ,Serializable' END"
)


@query(
    "java_types",
    f"WITH x AS (SELECT p_partkey, p_type, {JAVA_TYPE} AS t FROM {{part}}) SELECT p_partkey, "
    "CASE p_partkey % 4 WHEN 0 THEN t WHEN 1 THEN 'java.util.Map' WHEN 2 THEN 'List[][]' ELSE 'Map.Entry' END AS stripped, "
    "CASE p_partkey % 4 WHEN 0 THEN t WHEN 1 THEN 'Map' WHEN 2 THEN 'List[][]' ELSE 'Entry' END AS simple, "
    "CASE WHEN p_partkey % 4 < 3 THEN trim(t) ELSE 'Map.Entry<K,V>|Comparable<' || p_type || '>|Serializable' END AS parts FROM x",
)
def java_types(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.expr(JAVA_TYPE).alias("t"))
    return rows.select(
        "p_partkey", names.strip_generics("t").alias("stripped"), names.simple_name("t").alias("simple"),
        F.array_join(names.split_top_level("t"), "|").alias("parts"),
    )


@query(
    "java_visibility",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 5 IN (0, 4) THEN 'public' WHEN s_suppkey % 5 = 1 THEN 'protected' WHEN s_suppkey % 5 = 2 THEN 'private' ELSE 'package' END AS visibility FROM {supplier}",
)
def java_visibility(t: Tables) -> DataFrame:
    modifiers = F.expr(
        "CASE s_suppkey % 5 WHEN 0 THEN 'public static' WHEN 1 THEN '@A protected final' WHEN 2 THEN 'private' WHEN 3 THEN 'static' ELSE 'private public' END"
    )
    return t.supplier.select("s_suppkey", names.java_visibility(modifiers).alias("visibility"))


@query(
    "java_imports",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'com.' || lower(p_type) END AS package, "
    "CASE WHEN p_partkey % 4 = 1 THEN 'com.' || lower(p_type) || '.P' || CAST(p_partkey AS VARCHAR) END AS class FROM {part}",
)
def java_imports(t: Tables) -> DataFrame:
    line = F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN 'import com.' || lower(p_type) || '.*;' WHEN 1 THEN 'import com.' || lower(p_type) || '.P' || p_partkey || ';' "
        "WHEN 2 THEN 'import static com.' || lower(p_type) || '.P.x;' ELSE 'import Bare;' END"
    )
    return t.part.select("p_partkey", names.import_package(line).alias("package"), names.import_class(line).alias("class"))


@query(
    "type_resolution",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'lib.' || p_type WHEN p_size % 3 = 1 THEN 'own.' || p_type ELSE p_type END AS resolved FROM {part} "
    "WHERE NOT (p_size % 3 = 1 AND 'own.' || p_type = 'own.SMALL') AND p_type <> 'ECONOMY'",
)
def type_resolution(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey", F.lit("java").alias("lang"), F.col("p_type").alias("type_name"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("lib."), "p_type")).alias("imported"),
        F.when(F.col("p_size") % 3 == 1, "own").alias("package"), F.lit("own.SMALL").alias("src_fqn"),
    )
    kept = rows.where(~names.is_noise("lang", "type_name", {"java": ("ECONOMY",)}))
    return names.resolve_types(kept).select("p_partkey", "resolved")


# Line items as type mentions in a supplier's file; even parts are imported there.
JAVA_MENTIONS = (
    "SELECT CAST(1 AS BIGINT) AS repo_id, CAST(l_suppkey AS BIGINT) AS file_id, 'own.C' || CAST(l_suppkey AS VARCHAR(20)) AS src_fqn, 'own' AS package, CAST(l_partkey AS BIGINT) AS part, "
    "CASE l_linenumber % 5 WHEN 0 THEN 'String' WHEN 1 THEN 'P' || CAST(l_partkey AS VARCHAR(20)) || '<Map<String, Long>>' WHEN 2 THEN ' P' || CAST(l_partkey AS VARCHAR(20)) || '[]' "
    "WHEN 3 THEN 'C' || CAST(l_suppkey AS VARCHAR(20)) ELSE 'P' || CAST(l_partkey AS VARCHAR(20)) END AS type_text FROM {lineitem}"
)
GO_MENTIONS = (
    "SELECT CAST(1 AS BIGINT) AS repo_id, CAST(l_suppkey AS BIGINT) AS file_id, 'm/own.C' || CAST(l_suppkey AS VARCHAR(20)) AS src_fqn, 'm/own' AS package, CAST(l_partkey AS BIGINT) AS part, "
    "CASE l_linenumber % 4 WHEN 0 THEN 'map[string]*q' || CAST(l_partkey % 9 AS VARCHAR(20)) || '.T' WHEN 1 THEN '[8]lib' || CAST(l_partkey % 9 AS VARCHAR(20)) || '.T' "
    "WHEN 2 THEN 'chan<- []C' || CAST(l_suppkey + l_partkey % 2 AS VARCHAR(20)) ELSE 'Box[int, none.T]' END AS type_text FROM {lineitem}"
)
GO_IMPORTS = "SELECT DISTINCT repo_id, file_id, part % 9 AS pos, CASE WHEN part % 2 = 0 THEN 'q' || CAST(part % 9 AS VARCHAR(20)) END AS alias, 'm/x/lib' || CAST(part % 9 AS VARCHAR(20)) AS path FROM ({mentions}) i WHERE part % 9 < 6"


@query(
    "java_type_refs",
    f"WITH m AS ({JAVA_MENTIONS}), n AS (SELECT file_id, src_fqn, part, CASE WHEN strpos(type_text, '<') > 0 THEN split_part(type_text, '<', 1) ELSE type_text END AS name FROM m WHERE type_text <> 'String' AND NOT ends_with(type_text, '[]')), "
    "i AS (SELECT DISTINCT file_id, 'P' || CAST(part AS VARCHAR) AS name, 'lib.n' || CAST(part % 7 AS VARCHAR) || '.P' || CAST(part AS VARCHAR) AS cls FROM m WHERE part % 2 = 0) "
    "SELECT DISTINCT n.file_id, n.src_fqn, coalesce(i.cls, 'own.' || n.name) AS ref_text FROM n LEFT JOIN i ON i.file_id = n.file_id AND i.name = n.name WHERE coalesce(i.cls, 'own.' || n.name) <> n.src_fqn",
)
def java_type_refs(t: Tables) -> DataFrame:
    """From mentions and import statements to refs: the import map of each file joined."""
    mentions = materialize(t.spark.sql(JAVA_MENTIONS, lineitem=t.lineitem), "java-mentions")
    statement = F.concat(F.lit("import lib.n"), F.col("part") % 7, F.lit(".P"), "part", F.lit(";"))
    imports = mentions.where("part % 2 = 0").select("repo_id", "file_id", F.col("part").alias("pos"), statement.alias("text")).distinct()
    return typerefs.java_type_refs(mentions, imports).select("file_id", "src_fqn", "ref_text")


@query(
    "go_type_refs",
    f"WITH m AS ({GO_MENTIONS}), i AS ({GO_IMPORTS.replace('{mentions}', 'SELECT * FROM m')}), a AS (SELECT file_id, coalesce(alias, split_part(path, '/', -1)) AS alias, path FROM i), "
    "s AS (SELECT file_id, src_fqn, regexp_extract(type_text, '((q|lib)[0-9]+)[.]T$', 1) AS alias FROM m WHERE regexp_matches(type_text, '(q|lib)[0-9]+[.]T$')) "
    "SELECT DISTINCT s.file_id, s.src_fqn, a.path || '.T' AS ref_text FROM s JOIN a ON a.file_id = s.file_id AND a.alias = s.alias UNION "
    "SELECT file_id, src_fqn, 'm/own.' || regexp_extract(type_text, '(C[0-9]+)$', 1) FROM m WHERE starts_with(type_text, 'chan') AND 'm/own.' || regexp_extract(type_text, '(C[0-9]+)$', 1) <> src_fqn UNION "
    "SELECT file_id, src_fqn, 'm/own.Box' FROM m WHERE starts_with(type_text, 'Box')",
)
def go_type_refs(t: Tables) -> DataFrame:
    """From type expressions and imports to refs: the alias map of each file joined."""
    mentions = materialize(t.spark.sql(GO_MENTIONS, lineitem=t.lineitem), "go-mentions")
    imports = t.spark.sql(GO_IMPORTS.replace("({mentions})", "{mentions}"), mentions=mentions)
    return typerefs.go_type_refs(mentions, imports).select("file_id", "src_fqn", "ref_text")


@query(
    "noise_names",
    "SELECT id, lang, word, lang = 'go' AND word = 'error' OR lang IN ('java', 'javascript', 'typescript') AND word = 'Error' OR lang = 'javascript' AND word = 'Map' "
    "OR lang = 'typescript' AND word IN ('Map', 'any') OR lang = 'go' AND word = 'any' AS noise FROM (SELECT id, lang, CASE id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'Error' WHEN 2 THEN 'Map' WHEN 3 THEN 'any' ELSE name END AS word FROM {code_symbols}) w",
)
def noise_names(t: Tables) -> DataFrame:
    word = F.expr("CASE id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'Error' WHEN 2 THEN 'Map' WHEN 3 THEN 'any' ELSE name END")
    rows = t.code_symbols.select("id", "lang", word.alias("word"))
    return rows.withColumn("noise", names.is_noise("lang", "word", names.SKIPPED_TYPES))


@query(
    "noise_calls",
    "SELECT id, lang, word, made, lang = 'java' AND (made AND word = 'StringBuilder' OR NOT made AND word IN ('super', 'synchronized')) AS noise FROM (SELECT id, lang, id % 3 = 0 AS made, "
    "CASE id % 5 WHEN 0 THEN 'StringBuilder' WHEN 1 THEN 'super' WHEN 2 THEN 'synchronized' ELSE name END AS word FROM {code_symbols}) w",
)
def noise_calls(t: Tables) -> DataFrame:
    word = F.expr("CASE id % 5 WHEN 0 THEN 'StringBuilder' WHEN 1 THEN 'super' WHEN 2 THEN 'synchronized' ELSE name END")
    rows = t.code_symbols.select("id", "lang", word.alias("word"), (F.col("id") % 3 == 0).alias("made"))
    return rows.withColumn("noise", names.is_skipped_call("lang", "word", "made"))


@query(
    "module_names",
    "SELECT path, regexp_replace(path, '[.][^./]*$', '') AS module, CASE WHEN path LIKE 'src/%' THEN substr(path, 5) ELSE path END AS relative FROM {doc_files}",
)
def module_names(t: Tables) -> DataFrame:
    return t.doc_files.select(
        "path", paths.module_name("path").alias("module"), paths.relative_path("path", F.lit("src")).alias("relative")
    )


@query(
    "location_json",
    "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN 'u' || CAST(user_id AS VARCHAR) || '.go' END AS path, CASE WHEN event_id % 5 < 4 THEN CAST(event_id % 100 + 1 AS INTEGER) END AS line FROM {events}",
)
def location_json(t: Tables) -> DataFrame:
    spot = "'{\"start\":{\"line\":' || (event_id % 100) || ',\"character\":2},\"end\":{\"line\":9}}'"
    uri = "'\"file:///work/u' || user_id || '.go\"'"
    raw = F.expr(
        f"CASE event_id % 5 WHEN 0 THEN '[{{\"uri\":' || {uri} || ',\"range\":' || {spot} || '}}]' "
        f"WHEN 1 THEN '{{\"uri\":' || {uri} || ',\"range\":' || {spot} || '}}' "
        f"WHEN 2 THEN '[{{\"targetUri\":' || {uri} || ',\"targetSelectionRange\":' || {spot} || '}}]' "
        f"WHEN 3 THEN '[{{\"uri\":' || {uri} || ',\"range\":' || {spot} || '}},{{\"uri\":\"file:///x\"}}]' ELSE 'null' END"
    )
    rows = t.events.select("event_id", F.try_element_at(paths.parse_locations(raw), F.lit(1)).alias("loc"))
    return rows.select("event_id", paths.uri_to_path("loc.uri", F.lit("/work")).alias("path"), F.col("loc.line").alias("line"))


@query(
    "note_normalisation",
    "SELECT doc_id, regexp_replace(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))), '\\s+', ' ', 'g') AS title, "
    "sha256(regexp_replace(replace(replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')) AS hash, "
    "CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE 'repo:' || lower(source) END AS scope FROM {documents}",
)
def note_normalisation(t: Tables) -> DataFrame:
    scope = F.expr("CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE ' Repo:' || source || ' ' END")
    return t.documents.select(
        "doc_id", text.normalize_title("text").alias("title"), text.content_hash("text").alias("hash"),
        text.normalize_scope(scope).alias("scope"),
    )


@query(
    "tag_lists",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '[]' ELSE '[\"' || lower(lang) || '\",\"' || lower(source) || '\"]' END AS tags FROM {documents}",
)
def tag_lists(t: Tables) -> DataFrame:
    raw = F.expr("CASE WHEN doc_id % 4 = 0 THEN 'not json' ELSE '[\" ' || upper(lang) || '\",\"' || source || '\",\"' || lang || '\",\" \"]' END")
    return t.documents.select("doc_id", text.tags_to_json(text.normalize_tags(text.tags_from_json(raw))).alias("tags"))


@query(
    "numbers_and_times",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber - 3 <= 0 THEN 5 ELSE least(l_linenumber * 7, 20) END AS clamped, "
    "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, epoch(l_shipdate)::BIGINT AS back FROM {lineitem}",
)
def numbers_and_times(t: Tables) -> DataFrame:
    value = F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber") - 3).otherwise(F.col("l_linenumber") * 7)
    stamp = text.format_rfc3339(F.col("l_shipdate").cast("timestamp"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", text.clamp(value, 1, 20, 5).alias("clamped"), stamp.alias("stamp"),
        F.unix_seconds(text.parse_rfc3339(stamp)).alias("back"),
    )


@query(
    "search_expressions",
    "SELECT item_id, list_aggregate(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(replace(q, '\"', '\"\"'), '[*^():-]', ' ', 'g'), "
    "'\\b(?:and|or|not)\\b', '', 'gi'), '\\s+'), lambda w: w <> ''), lambda w: w || '*'), 'string_agg', ' ') AS expression FROM "
    "(SELECT item_id, 'NOT \"' || text || '\" OR and-or' AS q FROM {benchmark}) b",
)
def search_expressions(t: Tables) -> DataFrame:
    q = F.concat(F.lit('NOT "'), "text", F.lit('" OR and-or'))
    return t.benchmark.select("item_id", search_ops.match_expression(q).alias("expression"))
