"""The driver tables recast as code graphs, notes and files.

Each fixture is one SQL text that both Spark and the checking engine run, with
``{name}`` standing for a driver table or another fixture.  Operators are not
part of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Ids of symbols: language number, level, key of the row.
LANG_NO = {"go": 1, "java": 2, "javascript": 3, "typescript": 4}
LEVEL_NO = {"region": 1, "nation": 2, "supplier": 3, "customer": 4, "part": 5, "maker": 6}


def sid(lang: str, level: str, key: str) -> str:
    """SQL of a symbol id."""
    return f"({LANG_NO[lang] * 10**15 + LEVEL_NO[level] * 10**13} + CAST({key} AS BIGINT))"


def _symbol_rows(lang: str, level: str, key: str, file_key: str, kind: str, name: str, fqn: str, source: str) -> str:
    return (
        f"SELECT {sid(lang, level, key)} AS id, CAST({LANG_NO[lang]} AS BIGINT) AS repo_id, "
        f"{sid(lang, 'nation', file_key)} AS file_id, '{lang}' AS lang, {kind} AS kind, {name} AS name, {fqn} AS fqn "
        f"FROM {source}"
    )


# Region -> package or module, nation -> type, supplier -> method, customer -> field, part -> function.
_NATION = "{nation} JOIN {region} ON n_regionkey = r_regionkey"
_SUPPLIER = (
    "(SELECT n_nationkey, n_name, r_name, min(s_suppkey) AS s_suppkey, 'm' || CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS VARCHAR(20)) AS m "
    "FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey "
    "GROUP BY n_nationkey, n_name, r_name, CAST(floor(s_suppkey / 2) AS BIGINT)) s"
)
_CUSTOMER = "{customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
_PART = "{part} JOIN {nation} ON p_partkey % 25 = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
_C = "'c' || CAST(c_custkey AS VARCHAR(20))"
_P = "'f' || CAST(p_partkey AS VARCHAR(20))"


def _go() -> list[str]:
    pkg = "'shop.io/' || r_name"
    return [
        _symbol_rows("go", "region", "r_regionkey", "r_regionkey", "'package'", "r_name", pkg, "{region}"),
        _symbol_rows("go", "nation", "n_nationkey", "n_nationkey",
                     "CASE WHEN n_nationkey % 2 = 0 THEN 'type' ELSE 'interface' END", "n_name",
                     f"{pkg} || '.' || n_name", _NATION),
        _symbol_rows("go", "supplier", "s_suppkey", "n_nationkey", "'method'", "m",
                     f"CASE WHEN n_nationkey % 2 = 0 THEN {pkg} || '.(' || n_name || ').' || m "
                     f"ELSE {pkg} || '.' || n_name || '.' || m END", _SUPPLIER),
        _symbol_rows("go", "customer", "c_custkey", "n_nationkey", "'field'", _C,
                     f"{pkg} || '.' || n_name || '.' || {_C}", _CUSTOMER),
        _symbol_rows("go", "part", "p_partkey", "n_nationkey", "'function'", _P, f"{pkg} || '.' || {_P}", _PART),
    ]


def _java() -> list[str]:
    pkg = "'com.' || lower(r_name)"
    cls = f"{pkg} || '.' || n_name"
    return [
        _symbol_rows("java", "region", "r_regionkey", "r_regionkey", "'package'", "lower(r_name)", pkg, "{region}"),
        _symbol_rows("java", "nation", "n_nationkey", "n_nationkey",
                     "CASE n_nationkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' ELSE 'enum' END", "n_name", cls,
                     _NATION),
        _symbol_rows("java", "maker", "n_nationkey", "n_nationkey", "'constructor'", "n_name",
                     f"{cls} || '#' || n_name || '(int)'", _NATION),
        _symbol_rows("java", "supplier", "s_suppkey", "n_nationkey", "'method'", "m",
                     f"{cls} || '#' || m || '(String,int):void'", _SUPPLIER),
        _symbol_rows("java", "customer", "c_custkey", "n_nationkey", "'field'", _C, f"{cls} || '.' || {_C}", _CUSTOMER),
        _symbol_rows("java", "part", "p_partkey", "n_nationkey", "'method'", _P,
                     f"{cls} || '#' || {_P} || '():int'", _PART),
    ]


def _javascript() -> list[str]:
    module = "'src/' || r_name"
    return [
        _symbol_rows("javascript", "nation", "n_nationkey", "n_nationkey", "'class'", "n_name",
                     f"{module} || '.' || n_name", _NATION),
        _symbol_rows("javascript", "supplier", "s_suppkey", "n_nationkey", "'method'", "m",
                     f"{module} || '.' || n_name || '.' || m", _SUPPLIER),
        _symbol_rows("javascript", "customer", "c_custkey", "n_nationkey", "'variable'", _C,
                     f"{module} || '.' || {_C}", _CUSTOMER),
        _symbol_rows("javascript", "part", "p_partkey", "n_nationkey", "'function'", _P,
                     f"{module} || '.' || n_name || '.' || {_P}", _PART),
    ]


def _typescript() -> list[str]:
    module = "'app/' || r_name"
    return [
        _symbol_rows("typescript", "nation", "n_nationkey", "n_nationkey",
                     "CASE n_nationkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'enum' WHEN 2 THEN 'interface' ELSE 'function' END",
                     "n_name", f"{module} || '.' || n_name", _NATION),
        _symbol_rows("typescript", "supplier", "s_suppkey", "n_nationkey", "'method'", "m",
                     f"{module} || '.' || n_name || '.' || m", _SUPPLIER),
        _symbol_rows("typescript", "customer", "c_custkey", "n_nationkey",
                     "CASE WHEN n_nationkey % 4 = 1 THEN 'enum_member' ELSE 'arrow_function' END", _C,
                     f"{module} || '.' || n_name || '.' || {_C}", _CUSTOMER),
        _symbol_rows("typescript", "part", "p_partkey", "n_nationkey", "'arrow_function'", _P,
                     f"{module} || '.' || {_P}", _PART),
    ]


def _callsites() -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({no} AS BIGINT) AS repo_id, {sid(lang, 'part', 'l_partkey')} AS caller, "
        "'x.m' || CAST(CAST(floor(l_suppkey / 2) AS BIGINT) AS VARCHAR(20)) AS callee_text FROM {lineitem}"
        for lang, no in LANG_NO.items()
    )


def _refs() -> str:
    rows = []
    for lang, pkg in (("go", "'shop.io/' || b.r_name"), ("java", "'com.' || lower(b.r_name)")):
        rows.append(
            f"SELECT CAST({LANG_NO[lang]} AS BIGINT) AS repo_id, {sid(lang, 'region', 'n_regionkey')} AS src, {pkg} AS ref_text, "
            "'extractor' AS provenance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey "
            "JOIN {region} b ON b.r_regionkey = c_custkey % 7"
        )
    for provenance, step in (("extends-heuristic", "s_suppkey % 25"), ("implements-heuristic", "s_suppkey * 7 % 25")):
        rows.append(
            f"SELECT CAST(2 AS BIGINT) AS repo_id, {sid('java', 'nation', 's_nationkey')} AS src, "
            f"'NATION_' || CAST({step} AS VARCHAR(20)) AS ref_text, '{provenance}' AS provenance FROM {{supplier}}"
        )
    for lang, fqn in (
        ("go", "'shop.io/' || r_name || '.' || n_name"), ("java", "'com.' || lower(r_name) || '.' || n_name"),
        ("javascript", "CASE p_partkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE 'src/' || r_name || '.' || n_name END"),
        ("typescript", "CASE p_partkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE lower('app/' || r_name || '.' || n_name) END"),
    ):
        rows.append(
            f"SELECT CAST({LANG_NO[lang]} AS BIGINT) AS repo_id, {sid(lang, 'part', 'p_partkey')} AS src, {fqn} AS ref_text, "
            "'type-ref' AS provenance FROM {part} JOIN {nation} ON p_size % 25 = n_nationkey "
            "JOIN {region} ON n_regionkey = r_regionkey"
        )
    return " UNION ALL ".join(rows)


def _trade_edges() -> str:
    def edge(kind: str, src: str, dst: str, source: str) -> str:
        return (
            f"SELECT DISTINCT CAST(1 AS BIGINT) AS repo_id, '{kind}' AS kind, CAST({src} AS BIGINT) AS src, "
            f"CAST({dst} AS BIGINT) AS dst FROM {source}"
        )

    return " UNION ALL ".join([
        edge("CALLS", "o_custkey * 4", "l_partkey * 4 + 1", "{orders} JOIN {lineitem} ON l_orderkey = o_orderkey"),
        edge("CALLS", "l_partkey * 4 + 1", "l_suppkey * 4 + 2", "{lineitem}"),
        edge("REFERENCES", "s_suppkey * 4 + 2", "s_nationkey * 4 + 3", "{supplier}"),
        edge("REFERENCES", "c_nationkey * 4 + 3", "c_custkey * 4", "{customer}"),
        edge("IMPLEMENTS", "c_custkey * 4", "c_nationkey * 4 + 3", "{customer}"),
        edge("OVERRIDES", "l_partkey * 4 + 1", "l_suppkey * 4 + 2", "{lineitem}"),
    ])


def _trade_symbols() -> str:
    def node(no: int, key: str, kind: str, name: str, table: str) -> str:
        return (
            f"SELECT CAST({key} * 4 + {no} AS BIGINT) AS id, CAST(1 AS BIGINT) AS repo_id, 'go' AS lang, '{kind}' AS kind, "
            f"{name} AS name, 'trade.' || {name} AS fqn FROM {{{table}}}"
        )

    return " UNION ALL ".join([
        node(0, "c_custkey", "type", "c_name", "customer"),
        node(1, "p_partkey", "function", "'P' || CAST(p_partkey AS VARCHAR(20)) || ' ' || p_name", "part"),
        node(2, "s_suppkey", "method", "s_name", "supplier"),
        node(3, "n_nationkey", "interface", "n_name", "nation"),
    ])


_METHOD_SIZES = "(SELECT DISTINCT o_custkey, p_size FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey) t"
_NEEDS = (
    "(SELECT DISTINCT n_nationkey, size FROM ("
    "SELECT n_nationkey, n_nationkey % 50 + 1 AS size FROM {nation} UNION ALL "
    "SELECT n_nationkey, n_nationkey * 7 % 50 + 1 FROM {nation} UNION ALL "
    "SELECT n_nationkey, n_nationkey * 13 % 50 + 1 FROM {nation}) x) need"
)

IGNORE_LINES = ("node_modules/", "*.min.js", "# comment", "/build", "!/build/out", "src/src1*", "!d1*.min.js")

FIXTURES: dict[str, str] = {
    "code_symbols": " UNION ALL ".join([*_go(), *_java(), *_javascript(), *_typescript()]),
    "code_callsites": _callsites(),
    "code_refs": _refs(),
    "trade_edges": _trade_edges(),
    "trade_symbols": _trade_symbols(),
    # Customer -> type with one method per part size bought; nation -> interface with up to three sizes.
    "division_symbols": " UNION ALL ".join([
        "SELECT CAST(c_custkey * 4 AS BIGINT) AS id, CAST(1 AS BIGINT) AS repo_id, 'go' AS lang, 'type' AS kind, c_name AS name FROM {customer}",
        "SELECT CAST(n_nationkey * 4 + 1 AS BIGINT), CAST(1 AS BIGINT), 'go', 'interface', n_name FROM {nation}",
        "SELECT CAST((o_custkey * 64 + p_size) * 4 + 2 AS BIGINT), CAST(1 AS BIGINT), 'go', 'method', "
        f"'m' || CAST(p_size AS VARCHAR(20)) FROM {_METHOD_SIZES}",
        "SELECT CAST((n_nationkey * 64 + size) * 4 + 3 AS BIGINT), CAST(1 AS BIGINT), 'go', 'method', "
        f"'m' || CAST(size AS VARCHAR(20)) FROM {_NEEDS}",
    ]),
    "division_contains": " UNION ALL ".join([
        "SELECT CAST(1 AS BIGINT) AS repo_id, 'CONTAINS' AS kind, CAST(o_custkey * 4 AS BIGINT) AS src, "
        f"CAST((o_custkey * 64 + p_size) * 4 + 2 AS BIGINT) AS dst FROM {_METHOD_SIZES}",
        "SELECT CAST(1 AS BIGINT), 'CONTAINS', CAST(n_nationkey * 4 + 1 AS BIGINT), "
        f"CAST((n_nationkey * 64 + size) * 4 + 3 AS BIGINT) FROM {_NEEDS}",
    ]),
    # User -> file, signup -> function span of varying length, plus one span around everything per user.
    "span_symbols": (
        "SELECT event_id AS id, CAST(1 AS BIGINT) AS repo_id, user_id AS file_id, 'go' AS lang, 'function' AS kind, "
        "'h' || CAST(event_id % 50 AS VARCHAR(20)) AS name, event_id AS start_byte, event_id + 40 + event_id * 37 % 997 AS end_byte "
        "FROM {events} WHERE event_type = 'signup' UNION ALL "
        "SELECT DISTINCT -user_id - 1, CAST(1 AS BIGINT), user_id, 'go', 'method', 'all', CAST(0 AS BIGINT), CAST(4000000000 AS BIGINT) FROM {events}"
    ),
    "span_callsites": (
        "SELECT event_id AS id, CAST(1 AS BIGINT) AS repo_id, user_id AS file_id, CAST(NULL AS BIGINT) AS caller, "
        "'view.h' || CAST(event_id % 60 AS VARCHAR(20)) AS callee_text, event_id AS start_byte, event_id + event_id % 5 AS end_byte, "
        "CAST(NULL AS BIGINT) AS resolved FROM {events} WHERE event_type <> 'signup'"
    ),
    "span_files": "SELECT DISTINCT user_id AS id, CAST(1 AS BIGINT) AS repo_id, 'u' || CAST(user_id AS VARCHAR(20)) || '.go' AS path, 'java' AS lang FROM {events}",
    # Document -> note request.
    "note_requests": (
        "SELECT CAST(doc_id AS VARCHAR(20)) AS req_id, 1704067200 + doc_id AS ts_sec, "
        "substr(split_part(text, chr(10), 1), 1, 100) AS title, text AS content, "
        "split(lang || ',' || source || ',' || upper(lang), ',') AS tags, 'repo:' || source AS scope FROM {documents}"
    ),
    # Document -> source file.
    "doc_files": (
        "SELECT doc_id % 4 AS repo_id, doc_id, "
        "CASE doc_id % 7 WHEN 0 THEN 'vendor/' WHEN 1 THEN '.cache/' WHEN 2 THEN 'node_modules/pkg/' WHEN 3 THEN 'build/out/' "
        "WHEN 4 THEN 'src/' ELSE '' END || source || '/d' || CAST(doc_id AS VARCHAR(20)) || "
        "CASE doc_id % 11 WHEN 0 THEN '.go' WHEN 1 THEN '.java' WHEN 2 THEN '.JS' WHEN 3 THEN '.mjs' WHEN 4 THEN '.ts' "
        "WHEN 5 THEN '.TSX' WHEN 6 THEN '.htm' WHEN 7 THEN '.css' WHEN 8 THEN '.md' WHEN 9 THEN '.min.js' ELSE '' END AS path, "
        "lang AS doc_lang, text AS content, n_chars AS size, doc_id * 10 AS mtime FROM {documents}"
    ),
    "ignore_lines": " UNION ALL ".join(
        f"SELECT DISTINCT doc_id % 4 AS repo_id, CAST({i} AS BIGINT) AS ord, '{line}' AS line FROM {{documents}}"
        for i, line in enumerate(IGNORE_LINES)
    ),
    "page_files": "SELECT CAST(1 AS BIGINT) AS repo_id, page_id AS file_id, 'site/p' || CAST(page_id AS VARCHAR(20)) || '.html' AS path, html AS content FROM {pages}",
    # Part -> small markup file with ids, custom elements and sources; customer -> style sheet.
    "markup_files": (
        "SELECT CAST(1 AS BIGINT) AS repo_id, p_partkey AS file_id, 'web/' || lower(p_type) || '/p' || CAST(p_partkey AS VARCHAR(20)) || '.html' AS path, "
        "'<!-- <div id=\"no\"> -->' || chr(10) || '<section id=\"part-' || CAST(p_partkey AS VARCHAR(20)) || '\" title=\"' || p_name || '\">' || chr(10) || "
        "'  <h2 id=' || lower(p_type) || '>é ' || p_name || '</h2><part-card data-id=\"x\" id=''card' || CAST(p_size AS VARCHAR(20)) || '''></part-card>' || chr(10) || "
        "'<script src=\"/js/' || lower(p_type) || '.js\" id=\"s\"></script><link href=\"/css/' || p_brand || '.css\">' || chr(10) || "
        "'<script>import x from \"./m' || CAST(p_size AS VARCHAR(20)) || '.js\"; function show(a, b) ' || chr(123) || ' if (a) ' || chr(123) || ' cart.add(b, price(a)); ' || chr(125) || ' ' || chr(125) || ' // skip(me)' || chr(10) || "
        "'var y = require(''dep''); new Widget(\"call(me)\");</script></section>' AS content FROM {part}"
    ),
    "style_files": (
        "SELECT CAST(1 AS BIGINT) AS repo_id, c_custkey AS file_id, 'css/' || lower(c_mktsegment) || '/c' || CAST(c_custkey AS VARCHAR(20)) || '.css' AS path, "
        "'@import \"base' || CAST(c_nationkey AS VARCHAR(20)) || '.css\"; @import url(''t.css''); /* .gone ' || chr(123) || ' ' || chr(125) || ' */ ' || chr(10) || "
        "'.cust-' || CAST(c_custkey AS VARCHAR(20)) || ', #row' || CAST(c_custkey AS VARCHAR(20)) || ', div.seg:hover ' || chr(123) || ' --bal: 1; color: red; --seg: ' || lower(c_mktsegment) || ' ' || chr(125) || '' || chr(10) || "
        "'@media (min-width: 1px) ' || chr(123) || ' a.wide ' || chr(123) || ' margin: 0 ' || chr(125) || ' ' || chr(125) || ' ul .deep ' || chr(123) || ' ' || chr(125) || ' @keyframes k' || CAST(c_nationkey AS VARCHAR(20)) || ' ' || chr(123) || ' from ' || chr(123) || ' top: 0 ' || chr(125) || ' to ' || chr(123) || ' top: 1px ' || chr(125) || ' ' || chr(125) || '' AS content FROM {customer}"
    ),
    # Part -> style sheet with a rule inside as many others as the part's size; page -> its script inside a function.
    "deep_styles": (
        "SELECT CAST(1 AS BIGINT) AS repo_id, p_partkey AS file_id, 'deep/p' || CAST(p_partkey AS VARCHAR(20)) || '.css' AS path, "
        "'/* ' || p_name || ' ' || chr(125) || ' */' || chr(10) || repeat('@media all ' || chr(123) || ' ', p_size) || chr(10) || 'a[x=\"' || chr(125) || '\"], .d' || CAST(p_partkey AS VARCHAR(20)) || ' ' || chr(123) || "
        "' --é: ''' || chr(125) || ';''; --n' || CAST(p_partkey AS VARCHAR(20)) || ': 1' || repeat(chr(125), p_size + 1) || ' #end ' || chr(123) || chr(125) AS content FROM {part}"
    ),
    "scripted_pages": (
        "SELECT CAST(1 AS BIGINT) AS repo_id, page_id AS file_id, 'site/p' || CAST(page_id AS VARCHAR(20)) || '.html' AS path, "
        "replace(replace(html, '<script>', '<script>function p' || CAST(page_id AS VARCHAR(20)) || '(a) ' || chr(123)), '</script>', chr(125) || ' late(1)</script>') AS content FROM {pages}"
    ),
    # Two snapshots of a repository: documents before; after, toxic ones are gone, bad ones changed, pages are new.
    "snapshot_before": "SELECT CAST(1 AS BIGINT) AS repo_id, 'doc/' || CAST(doc_id AS VARCHAR(20)) AS path, md5(text) AS sha256, doc_id AS mtime FROM {documents}",
    "snapshot_after": (
        "SELECT CAST(1 AS BIGINT) AS repo_id, 'doc/' || CAST(d.doc_id AS VARCHAR(20)) AS path, "
        "CASE WHEN l.quality = 0 THEN md5(text || 'x') ELSE md5(text) END AS sha256, "
        "CASE WHEN l.quality = 1 AND n_chars % 2 = 0 THEN d.doc_id + 1 ELSE d.doc_id END AS mtime "
        "FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) = 0 UNION ALL "
        "SELECT CAST(1 AS BIGINT), 'page/' || CAST(page_id AS VARCHAR(20)), md5(html), page_id FROM {pages}"
    ),
    # Line items as edge writes in line order.
    "edge_writes": (
        "SELECT CAST(1 AS BIGINT) AS repo_id, 'CALLS' AS kind, l_partkey % 50 AS src, l_suppkey AS dst, l_discount AS confidence, "
        "'r' || l_returnflag || l_linestatus AS provenance, l_orderkey AS ord1, l_linenumber AS ord2, l_partkey AS ord3, "
        "l_extendedprice AS ord4 FROM {lineitem}"
    ),
}

_NAME = re.compile(r"\{(\w+)\}")


def dependencies(sql: str) -> list[str]:
    """Names a text refers to, in order of first use."""
    return list(dict.fromkeys(_NAME.findall(sql)))


#: Tables with long texts, and the key their rows are spread by.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
#: Fixtures that make a text of every row of a narrow table, and the key that table's rows are spread by.
MADE_TEXTS = {"markup_files": "p_partkey", "deep_styles": "p_partkey", "style_files": "c_custkey"}


def spread(table: DataFrame, key: str) -> DataFrame:
    """Rows of a table with fewer splits than cores, spread over all cores.

    A small file has one row group and would keep one core busy with all its
    texts.  A table with enough splits is returned as it is, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a fixture as a DataFrame."""
    if name in DRIVER_TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table, TEXT_KEYS[name]) if name in TEXT_KEYS else table
    sql = FIXTURES[name]
    tables = {d: load(spark, sf_dir, d) for d in dependencies(sql)}
    if name in MADE_TEXTS:
        tables = {d: spread(table, MADE_TEXTS[name]) for d, table in tables.items()}
    return spark.sql(sql, **tables)


def with_fixtures(sql: str) -> str:
    """Oracle text with the fixtures it uses in front, as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dependencies(text):
            if name in FIXTURES and name not in order:
                visit(FIXTURES[name])
                order.append(name)

    visit(sql)
    body = _NAME.sub(r"\1", sql)
    parts = [f"{name} AS ({_NAME.sub(chr(92) + '1', FIXTURES[name])})" for name in order]
    if not parts:
        return body
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + stripped[len("WITH RECURSIVE"):]
    if stripped.upper().startswith("WITH"):
        return "WITH " + ", ".join(parts) + ", " + stripped[len("WITH"):]
    return "WITH " + ", ".join(parts) + " " + body
