"""Traversal, lookup, statistics and export queries over the trade and code graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import lookup, stats, traverse
from loomgraph.plans.registry import Tables, query
from loomgraph.session import materialize, scratch_scope
from loomgraph.sources import export

# --- breadth-first traversals -------------------------------------------------

NATION_SEEDS = "SELECT min(c_custkey) * 4 AS seed FROM {customer} GROUP BY c_nationkey"
CUSTOMER_SEEDS = "SELECT c_custkey * 4 AS seed FROM {customer}"


def full_bfs_sql(seeds: str, here: str, there: str, kinds: tuple[str, ...], depth: int) -> str:
    kind_list = ", ".join(f"'{k}'" for k in kinds)
    return f"""
        WITH RECURSIVE steps AS (SELECT DISTINCT {here} AS a, {there} AS b FROM {{trade_edges}} WHERE kind IN ({kind_list})),
        walk AS (
            SELECT seed, seed AS id, 0 AS depth FROM ({seeds}) s
            UNION
            SELECT w.seed, t.b, w.depth + 1 FROM walk w JOIN steps t ON t.a = w.id WHERE w.depth < {depth}
        )
        SELECT seed, id, min(depth) AS depth FROM walk GROUP BY seed, id HAVING min(depth) > 0
    """


def capped_bfs_ctes(seeds: str, here: str, there: str, kinds: tuple[str, ...], depth: int, cap: int) -> str:
    """Common table expressions ending in ``reached``: levels unrolled, each cut to the cap."""
    kind_list = ", ".join(f"'{k}'" for k in kinds)
    parts = [
        f"steps AS (SELECT DISTINCT {here} AS a, {there} AS b FROM {{trade_edges}} WHERE kind IN ({kind_list}))",
        f"level0 AS (SELECT DISTINCT seed, seed AS id, 0 AS depth FROM ({seeds}) s)",
        "seen0 AS (SELECT * FROM level0)",
    ]
    for d in range(1, depth + 1):
        parts.append(
            f"level{d} AS (SELECT seed, id, {d} AS depth FROM ("
            f"SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY id) AS n FROM ("
            f"SELECT DISTINCT l.seed, t.b AS id FROM level{d - 1} l JOIN steps t ON t.a = l.id) f "
            f"WHERE NOT EXISTS (SELECT 1 FROM seen{d - 1} v WHERE v.seed = f.seed AND v.id = f.id)) r WHERE n <= {cap})"
        )
        parts.append(f"seen{d} AS (SELECT * FROM seen{d - 1} UNION ALL SELECT * FROM level{d})")
    parts.append(
        f"reached AS (SELECT seed, id, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS n "
        f"FROM seen{depth} WHERE depth > 0) r WHERE n <= {cap})"
    )
    return ", ".join(parts)


def seeds_of(t: Tables, sql: str) -> DataFrame:
    return t.spark.sql(sql, customer=t.customer)


def stored_edges(t: Tables, *kinds: str) -> DataFrame:
    """The trade edges of the kinds a traversal follows, written as a table first; others are not derived."""
    return materialize(t.trade_edges.where(F.col("kind").isin(*kinds)), "trade_edges")


@query("bfs_out", full_bfs_sql(NATION_SEEDS, "src", "dst", ("CALLS",), 3))
def bfs_out(t: Tables) -> DataFrame:
    return traverse.bfs(stored_edges(t, "CALLS"), seeds_of(t, NATION_SEEDS), "out", ("CALLS",), 3, None)


@query("bfs_in", full_bfs_sql("SELECT CAST(n_nationkey AS BIGINT) * 4 + 3 AS seed FROM {nation}", "dst", "src", ("CALLS", "REFERENCES"), 3))
def bfs_in(t: Tables) -> DataFrame:
    seeds = t.nation.select((F.col("n_nationkey").cast("long") * 4 + 3).alias("seed"))
    return traverse.bfs(stored_edges(t, "CALLS", "REFERENCES"), seeds, "in", ("CALLS", "REFERENCES"), 3, None)


@query(
    "bfs_capped",
    "WITH " + capped_bfs_ctes(CUSTOMER_SEEDS, "src", "dst", ("CALLS", "REFERENCES"), 3, 100)
    + " SELECT seed, id, depth FROM reached",
)
def bfs_capped(t: Tables) -> DataFrame:
    return traverse.bfs(stored_edges(t, "CALLS", "REFERENCES"), seeds_of(t, CUSTOMER_SEEDS), "out", ("CALLS", "REFERENCES"))


def traverse_sql(table: str, name_col: str, key: str, name: str, select: str = "") -> str:
    direction, kinds = traverse.TRAVERSALS[name]
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    seeds = f"SELECT {key} AS seed FROM {{{table}}}"
    return (
        "WITH " + capped_bfs_ctes(seeds, here, there, kinds, 3, 100)
        + f", asked AS (SELECT {name_col} AS query, {key} AS seed FROM {{{table}}})"
        + f" SELECT {select or 'a.query, r.seed, r.id, r.depth, y.kind, y.name, y.fqn'} FROM reached r JOIN asked a ON a.seed = r.seed "
        "JOIN {trade_symbols} y ON y.id = r.id"
    )


def run_traversal(t: Tables, name: str, queries: DataFrame) -> DataFrame:
    asked = queries.select(F.lit(1).cast("long").alias("repo_id"), "query")
    direction, kinds = traverse.TRAVERSALS[name]
    with scratch_scope(t.spark):  # the edges are read into the adjacency only
        graph = traverse.adjacency(stored_edges(t, *kinds), direction, kinds)
    return traverse.traverse(name, t.stored("trade_symbols"), t.trade_edges, asked, graph=graph).select(
        "query", "seed", "id", "depth", "kind", "name", "fqn"
    )


@query("callers", traverse_sql("supplier", "'trade.' || s_name", "s_suppkey * 4 + 2", "callers"))
def callers(t: Tables) -> DataFrame:
    return run_traversal(t, "callers", t.supplier.selectExpr("'trade.' || s_name AS query"))


@query("callees", traverse_sql("customer", "'trade.' || c_name", "c_custkey * 4", "callees"))
def callees(t: Tables) -> DataFrame:
    return run_traversal(t, "callees", t.customer.selectExpr("'trade.' || c_name AS query"))


@query("impact", traverse_sql("supplier", "s_name", "s_suppkey * 4 + 2", "impact"))
def impact(t: Tables) -> DataFrame:
    return run_traversal(t, "impact", t.supplier.selectExpr("s_name AS query"))


@query("impls", traverse_sql("nation", "'trade.' || n_name", "CAST(n_nationkey AS BIGINT) * 4 + 3", "impls"))
def impls(t: Tables) -> DataFrame:
    return run_traversal(t, "impls", t.nation.selectExpr("'trade.' || n_name AS query"))


@query("overriders", traverse_sql("supplier", "'trade.' || s_name", "s_suppkey * 4 + 2", "overriders"))
def overriders(t: Tables) -> DataFrame:
    return run_traversal(t, "overriders", t.supplier.selectExpr("'trade.' || s_name AS query"))


@query(
    "tree_lines",
    traverse_sql("nation", "'trade.' || n_name", "CAST(n_nationkey AS BIGINT) * 4 + 3", "impls",
                 "a.query, r.id, repeat('  ', r.depth) || '[' || y.kind || '] ' || y.fqn AS line"),
)
def tree_lines(t: Tables) -> DataFrame:
    return traverse.tree_lines(run_traversal(t, "impls", t.nation.selectExpr("'trade.' || n_name AS query"))).select(
        "query", "id", "line"
    )


@query(
    "neighbors_in",
    "SELECT DISTINCT dst AS id, src AS next FROM {trade_edges} WHERE kind IN ('CALLS', 'REFERENCES') AND dst % 4 >= 2",
)
def neighbors_in(t: Tables) -> DataFrame:
    nodes = t.trade_symbols.where("kind IN ('method', 'interface')").select("id")
    return traverse.neighbors(t.trade_edges, nodes, "in", ("CALLS", "REFERENCES"))


@query("neighbors_out", "SELECT DISTINCT src AS id, dst AS next FROM {trade_edges}")
def neighbors_out(t: Tables) -> DataFrame:
    return traverse.neighbors(t.trade_edges, t.trade_symbols.select("id"), "out")


@query(
    "ego_network",
    "SELECT n.id, e.kind, e.src, e.dst FROM {trade_symbols} n JOIN {trade_edges} e ON e.src = n.id OR e.dst = n.id "
    "WHERE n.kind = 'method'",
)
def ego_network(t: Tables) -> DataFrame:
    return traverse.ego_network(t.trade_edges, t.trade_symbols.where("kind = 'method'"))


@query(
    "ego_nodes",
    "WITH me AS (SELECT id FROM {trade_symbols} WHERE kind = 'interface') "
    "SELECT DISTINCT id, member FROM (SELECT me.id, e.src AS member FROM me JOIN {trade_edges} e ON e.dst = me.id UNION ALL "
    "SELECT me.id, e.dst FROM me JOIN {trade_edges} e ON e.src = me.id UNION ALL SELECT id, id FROM me) x",
)
def ego_nodes(t: Tables) -> DataFrame:
    return traverse.ego_nodes(t.trade_edges, t.trade_symbols.where("kind = 'interface'"))


# --- lookup ---------------------------------------------------------------------

@query("lookup_fqn", "SELECT id, kind, name, fqn FROM {code_symbols} WHERE fqn = 'shop.io/ASIA.NATION_2'")
def lookup_fqn(t: Tables) -> DataFrame:
    return lookup.by_fqn(t.stored("code_symbols"), "shop.io/ASIA.NATION_2").select("id", "kind", "name", "fqn")


@query("lookup_name", "SELECT id, kind, name, fqn FROM {code_symbols} WHERE contains(lower(name), 'nation_1')")
def lookup_name(t: Tables) -> DataFrame:
    return lookup.by_name(t.stored("code_symbols"), "nation_1").select("id", "kind", "name", "fqn")


@query("lookup_id", "SELECT id, name FROM {trade_symbols} WHERE id IN (SELECT l_suppkey * 4 + 2 FROM {lineitem})")
def lookup_id(t: Tables) -> DataFrame:
    ids = t.lineitem.select((F.col("l_suppkey") * 4 + 2).alias("id"))
    return lookup.by_id(t.trade_symbols, ids).select("id", "name")


# Names with and without a dot, with one hit, many hits and none.
ASKED = " UNION ALL ".join([
    "SELECT CAST(2 AS BIGINT) AS repo_id, n_name AS query FROM {nation}",
    "SELECT CAST(2 AS BIGINT), lower(n_name) FROM {nation}",
    "SELECT CAST(1 AS BIGINT), 'shop.io/' || r_name FROM {region}",
    "SELECT CAST(1 AS BIGINT), r_name FROM {region}",
    "SELECT CAST(1 AS BIGINT), 'shop.io/' || r_name || '.gone' FROM {region}",
    "SELECT CAST(3 AS BIGINT), 'm' || CAST(s_suppkey AS VARCHAR(20)) FROM {supplier}",
    "SELECT CAST(4 AS BIGINT), '_' || CAST(s_suppkey AS VARCHAR(20)) FROM {supplier}",
])


def asked(t: Tables) -> DataFrame:
    return t.spark.sql(ASKED, nation=t.nation, region=t.region, supplier=t.supplier)


QUERY_SYMBOLS = (
    f"WITH asked AS (SELECT DISTINCT * FROM ({ASKED}) a), "
    "exact AS (SELECT a.repo_id, a.query, s.id, s.kind, s.name, s.fqn FROM asked a JOIN {code_symbols} s "
    "ON s.repo_id = a.repo_id AND s.fqn = a.query WHERE contains(a.query, '.')) "
    "SELECT * FROM exact UNION ALL SELECT a.repo_id, a.query, s.id, s.kind, s.name, s.fqn FROM asked a JOIN {code_symbols} s "
    "ON s.repo_id = a.repo_id AND contains(lower(s.name), lower(a.query)) "
    "WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.repo_id = a.repo_id AND e.query = a.query)"
)


@query("query_symbols", QUERY_SYMBOLS)
def query_symbols(t: Tables) -> DataFrame:
    return lookup.query_symbols(t.stored("code_symbols"), asked(t))


@query("query_symbols_indexed", QUERY_SYMBOLS)
def query_symbols_indexed(t: Tables) -> DataFrame:
    """The same lookup over a stored index of the names."""
    symbols = t.stored("code_symbols")
    return lookup.query_symbols(symbols, asked(t), lookup.index_names(symbols))


@query(
    "fqn_ids",
    f"SELECT a.repo_id, a.query, coalesce(min(s.id), 0) AS id FROM (SELECT DISTINCT * FROM ({ASKED}) a) a "
    "LEFT JOIN {code_symbols} s ON s.repo_id = a.repo_id AND s.fqn = a.query GROUP BY a.repo_id, a.query",
)
def fqn_ids(t: Tables) -> DataFrame:
    return lookup.fqn_ids(t.stored("code_symbols"), asked(t))


LADDER = (
    f"WITH asked AS (SELECT DISTINCT * FROM ({ASKED}) a), "
    "exact AS (SELECT a.repo_id, a.query, min(s.id) AS id FROM asked a JOIN {code_symbols} s ON s.repo_id = a.repo_id AND s.fqn = a.query GROUP BY 1, 2), "
    "near AS (SELECT a.repo_id, a.query, count(*) AS n, min(s.id) AS any_id, "
    "count(*) FILTER (s.name = a.query) AS same, min(s.id) FILTER (s.name = a.query) AS same_id, "
    "count(*) FILTER (s.name = a.query AND s.kind IN ('function', 'method')) AS runs, "
    "min(s.id) FILTER (s.name = a.query AND s.kind IN ('function', 'method')) AS runs_id "
    "FROM asked a JOIN {code_symbols} s ON s.repo_id = a.repo_id AND contains(lower(s.name), lower(a.query)) GROUP BY 1, 2) "
)


@query(
    "resolve_names",
    LADDER + "SELECT a.repo_id, a.query, CASE WHEN e.id IS NOT NULL THEN e.id WHEN n.n = 1 THEN any_id WHEN same = 1 THEN same_id WHEN runs = 1 THEN runs_id END AS symbol_id, "
    "CASE WHEN e.id IS NOT NULL THEN 'fqn' WHEN n.n IS NULL THEN 'not_found' WHEN n.n = 1 THEN 'single' WHEN same = 1 THEN 'exact' "
    "WHEN runs = 1 THEN 'callable' ELSE 'ambiguous' END AS status, "
    "CASE WHEN e.id IS NOT NULL THEN 0 ELSE coalesce(n.n, 0) END AS candidates "
    "FROM asked a LEFT JOIN exact e ON e.repo_id = a.repo_id AND e.query = a.query "
    "LEFT JOIN near n ON n.repo_id = a.repo_id AND n.query = a.query",
)
def resolve_names(t: Tables) -> DataFrame:
    return lookup.resolve_names(t.stored("code_symbols"), asked(t))


@query(
    "ambiguous_candidates",
    LADDER + "SELECT a.repo_id, a.query, s.id, s.kind, s.fqn FROM asked a JOIN near n ON n.repo_id = a.repo_id AND n.query = a.query AND n.n > 1 AND same <> 1 AND runs <> 1 "
    "JOIN {code_symbols} s ON s.repo_id = a.repo_id AND contains(lower(s.name), lower(a.query)) "
    "WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.repo_id = a.repo_id AND e.query = a.query)",
)
def ambiguous_candidates(t: Tables) -> DataFrame:
    return lookup.ambiguous_candidates(t.stored("code_symbols"), asked(t))


@query("public_symbols", "SELECT id, repo_id, file_id, lang, kind, name, coalesce(fqn, '') AS fqn FROM {code_symbols}")
def public_symbols(t: Tables) -> DataFrame:
    return lookup.public_symbols(t.stored("code_symbols"))


# --- statistics -------------------------------------------------------------------

@query(
    "degrees",
    "SELECT n.id, count(e.id) AS degree FROM {trade_symbols} n LEFT JOIN "
    "(SELECT src AS id FROM {trade_edges} UNION ALL SELECT dst FROM {trade_edges}) e ON e.id = n.id GROUP BY n.id",
)
def degrees(t: Tables) -> DataFrame:
    return stats.degrees(t.trade_symbols, t.trade_edges)


@query(
    "degree_rings",
    """
    WITH d AS (SELECT n.id, count(e.id) AS degree FROM {trade_symbols} n LEFT JOIN
        (SELECT src AS id FROM {trade_edges} UNION ALL SELECT dst FROM {trade_edges}) e ON e.id = n.id GROUP BY n.id),
    r AS (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) AS rank, count(*) OVER () AS n FROM d),
    c AS (SELECT *, CAST(ceil(CAST(0.05 AS DOUBLE) * n) AS BIGINT) AS e0, CAST(ceil(CAST(0.15 AS DOUBLE) * n) AS BIGINT) AS e1,
        CAST(ceil(CAST(0.35 AS DOUBLE) * n) AS BIGINT) AS e2,
        CAST(CASE WHEN n < 100 THEN 28 WHEN n < 500 THEN 18 ELSE 12 END AS DOUBLE) AS arc FROM r),
    s AS (SELECT *, CASE WHEN e0 <= 1 THEN CAST(60 AS DOUBLE) ELSE e0 * arc / (2 * pi()) END AS s0,
        CASE WHEN e1 - e0 <= 1 THEN CAST(60 AS DOUBLE) ELSE (e1 - e0) * arc / (2 * pi()) END AS s1,
        CASE WHEN e2 - e1 <= 1 THEN CAST(60 AS DOUBLE) ELSE (e2 - e1) * arc / (2 * pi()) END AS s2,
        CASE WHEN n - e2 <= 1 THEN CAST(60 AS DOUBLE) ELSE (n - e2) * arc / (2 * pi()) END AS s3 FROM c),
    q0 AS (SELECT *, greatest(CAST(60 AS DOUBLE), s0) AS r0 FROM s),
    q1 AS (SELECT *, greatest(r0 + 70, s1) AS r1 FROM q0),
    q2 AS (SELECT *, greatest(r1 + 70, s2) AS r2 FROM q1),
    q3 AS (SELECT *, greatest(r2 + 70, s3) AS r3 FROM q2),
    p AS (SELECT id, degree, rank,
        CASE WHEN rank <= e0 THEN 0 WHEN rank <= e1 THEN 1 WHEN rank <= e2 THEN 2 ELSE 3 END AS ring,
        CASE WHEN rank <= e0 THEN r0 WHEN rank <= e1 THEN r1 WHEN rank <= e2 THEN r2 ELSE r3 END AS radius,
        CASE WHEN rank <= e0 THEN 0 WHEN rank <= e1 THEN e0 WHEN rank <= e2 THEN e1 ELSE e2 END AS begin_,
        CASE WHEN rank <= e0 THEN e0 WHEN rank <= e1 THEN e1 - e0 WHEN rank <= e2 THEN e2 - e1 ELSE n - e2 END AS size FROM q3)
    SELECT id, degree, rank, CAST(ring AS INTEGER) AS ring,
        round(radius * cos(2 * pi() * (rank - 1 - begin_) / size), 4) + 0 AS x,
        round(radius * sin(2 * pi() * (rank - 1 - begin_) / size), 4) + 0 AS y FROM p
    """,
)
def degree_rings(t: Tables) -> DataFrame:
    return stats.ring_layout(t.trade_symbols, t.trade_edges).select(
        "id", "degree", "rank", "ring", (F.round("x", 4) + 0).alias("x"), (F.round("y", 4) + 0).alias("y")
    )


@query(
    "graph_totals",
    "SELECT 'nodes' AS what, kind, count(*) AS n FROM {trade_symbols} GROUP BY kind UNION ALL "
    "SELECT 'edges', kind, count(*) FROM {trade_edges} GROUP BY kind",
)
def graph_totals(t: Tables) -> DataFrame:
    return stats.graph_totals(t.trade_symbols, t.trade_edges)


@query(
    "status_counts",
    "SELECT r.id AS repo_id, r.name, coalesce(f.n, 0) AS files, coalesce(s.n, 0) AS symbols, coalesce(c.n, 0) AS callsites, "
    "coalesce(c.resolved, 0) AS resolved, coalesce(CAST(f.last AS VARCHAR), 'never') AS last_indexed, "
    "CASE WHEN c.n > 0 THEN round(c.resolved * CAST(100 AS DOUBLE) / c.n, 6) ELSE CAST(0 AS DOUBLE) END AS resolved_pct "
    "FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM {nation}) r "
    "LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, max(c_custkey) AS last FROM {customer} GROUP BY 1) f ON f.k = r.id "
    "LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY 1) s ON s.k = r.id "
    "LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS resolved "
    "FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1) c ON c.k = r.id",
)
def status_counts(t: Tables) -> DataFrame:
    repos = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    files = t.customer.select(F.col("c_nationkey").cast("long").alias("repo_id"), F.col("c_custkey").alias("indexed_at"))
    symbols = t.supplier.select(F.col("s_nationkey").cast("long").alias("repo_id"))
    calls = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("long").alias("repo_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("resolved"),
    )
    return stats.repo_counts(repos, files, symbols, calls).withColumn("resolved_pct", F.round("resolved_pct", 6))


# --- whole-graph reads and export ---------------------------------------------------

@query(
    "graph_pruned",
    "SELECT e.kind, e.src, e.dst FROM {trade_edges} e WHERE EXISTS (SELECT 1 FROM {trade_symbols} a WHERE a.id = e.src AND a.kind IN ('function', 'method')) "
    "AND EXISTS (SELECT 1 FROM {trade_symbols} b WHERE b.id = e.dst AND b.kind IN ('function', 'method'))",
)
def graph_pruned(t: Tables) -> DataFrame:
    nodes = t.trade_symbols.where("kind IN ('function', 'method')")
    return export.graph(nodes, t.trade_edges, "go", prune_dangling=True)[1].select("kind", "src", "dst")


@query("graph_nodes_by_lang", "SELECT id, lang, kind, name, fqn FROM {code_symbols} WHERE lang = 'typescript'")
def graph_nodes_by_lang(t: Tables) -> DataFrame:
    return export.graph(t.stored("code_symbols"), t.trade_edges, "typescript")[0].select("id", "lang", "kind", "name", "fqn")


@query(
    "export_json_nodes",
    "SELECT id, '@<\"repo\":\"trade\",\"id\":' || CAST(id AS VARCHAR) || ',\"lang\":\"' || lang || '\",\"kind\":\"' || kind || '\",\"name\":\"' || name || "
    "'\",\"fqn\":\"' || fqn || '\",\"visibility\":\"public\",\"start_line\":' || CAST(id % 9 AS VARCHAR) || '>@' AS line FROM {trade_symbols}",
)
def export_json_nodes(t: Tables) -> DataFrame:
    nodes = t.trade_symbols.withColumns({
        "signature": F.lit(""), "visibility": F.lit("public"), "start_line": (F.col("id") % 9).cast("int"),
    })
    return export.json_nodes(nodes, "trade")


@query(
    "export_json_edges",
    "SELECT src * 100000000 + dst AS id, '@<\"repo\":\"trade\",\"id\":' || CAST(src * 100000000 + dst AS VARCHAR) || ',\"kind\":\"' || kind || '\",\"src\":' || CAST(src AS VARCHAR) || "
    "',\"dst\":' || CAST(dst AS VARCHAR) || ',\"confidence\":0.4,\"provenance\":\"treesitter\">@' AS line FROM {trade_edges}",
)
def export_json_edges(t: Tables) -> DataFrame:
    edges = t.trade_edges.withColumns({
        "id": F.col("src") * 100000000 + F.col("dst"), "confidence": F.lit(0.4), "provenance": F.lit("treesitter"),
    })
    return export.json_edges(edges, "trade")


@query(
    "export_graphml",
    "SELECT 1 AS part, id, '    <node id=\"n' || CAST(id AS VARCHAR) || '\">' || chr(10) || '      <data key=\"node_kind\">' || kind || '</data>' || chr(10) || "
    "'      <data key=\"name\">' || name || '</data>' || chr(10) || '      <data key=\"fqn\">' || fqn || '</data>' || chr(10) || "
    "'      <data key=\"lang\">' || lang || '</data>' || chr(10) || '    </node>' AS line FROM {trade_symbols} UNION ALL "
    "SELECT 2, src * 100000000 + dst, '    <edge id=\"e' || CAST(src * 100000000 + dst AS VARCHAR) || '\" source=\"n' || CAST(src AS VARCHAR) || '\" target=\"n' || "
    "CAST(dst AS VARCHAR) || '\">' || chr(10) || '      <data key=\"edge_kind\">' || kind || '</data>' || chr(10) || '    </edge>' FROM {trade_edges}",
)
def export_graphml(t: Tables) -> DataFrame:
    edges = t.trade_edges.withColumn("id", F.col("src") * 100000000 + F.col("dst"))
    return export.graphml_lines(t.trade_symbols, edges, "trade").where("part IN (1, 2)")
