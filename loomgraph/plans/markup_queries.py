"""Extraction queries over the web pages and derived markup files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import extract, plugin, spans
from loomgraph.plans.registry import Tables, query

LINK = "href=\"([^\"]*)\""


@query(
    "html_links",
    "SELECT DISTINCT page_id AS file_id, link AS ref_text FROM (SELECT page_id, unnest(regexp_extract_all("
    "regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '(?i)<script[^>]*>.*?</script>', ' ', 'gs'), '<[a-zA-Z][^>]*? href=\"([^\">]+)\"', 1)) AS link FROM {pages}) x",
)
def html_links(t: Tables) -> DataFrame:
    return extract.html_imports(t.page_files).select("file_id", "ref_text")


@query(
    "page_tags",
    "SELECT page_id AS file_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), "
    "'<script[^>]*>.*?</script>', ' ', 'gs'), '<style[^>]*>.*?</style>', ' ', 'gs'), '<([A-Za-z][^ />]*)[^>]*>', 1)) AS tag FROM {pages}) x GROUP BY page_id, tag",
)
def page_tags(t: Tables) -> DataFrame:
    return extract.start_tags(t.page_files).groupBy("file_id", "tag").agg(F.count(F.lit(1)).alias("n"))


# Places from a running sum over the pieces in front of each tag.
PLACES = (
    "WITH piece AS (SELECT page_id, i, pieces[i] AS p FROM (SELECT page_id, string_split(regexp_replace(html, "
    "'(<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[A-Za-z][^>]*>)', chr(1) || '\\1', 'gs'), chr(1)) AS pieces FROM {pages}) s, "
    "unnest(range(1, len(pieces) + 1)) AS u(i)), "
    "run AS (SELECT *, coalesce(string_agg(p, '') OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM piece) "
    "SELECT page_id AS file_id, regexp_extract(p, '^<([A-Za-z][^ />]*)', 1) AS tag, CAST(len(before) - len(replace(before, chr(10), '')) + 1 AS INTEGER) AS start_line, "
    "CAST(strlen(split_part(before, chr(10), -1)) + 1 AS INTEGER) AS start_col, CAST(strlen(before) AS BIGINT) AS start_byte "
    "FROM run WHERE regexp_matches(p, '^<[A-Za-z]') AND NOT regexp_matches(p, '^<(script|style)')"
)


@query("tag_places", PLACES)
def tag_places(t: Tables) -> DataFrame:
    return extract.located_tags(t.page_files).select("file_id", "tag", "start_line", "start_col", "start_byte")


@query("inline_calls", "SELECT page_id AS file_id, unnest(regexp_extract_all(regexp_extract(html, '<script>(.*?)</script>', 1, 's'), '([a-z]+)[(]', 1)) AS callee_text FROM {pages}")
def inline_calls(t: Tables) -> DataFrame:
    return extract.inline_calls(t.page_files).select("file_id", "callee_text")


PART_IDS = (
    "SELECT p_partkey AS file_id, 'part-' || CAST(p_partkey AS VARCHAR) AS name, 'section' AS tag FROM {part} UNION ALL "
    "SELECT p_partkey, lower(p_type), 'h2' FROM {part} UNION ALL SELECT p_partkey, 'card' || CAST(p_size AS VARCHAR), 'part-card' FROM {part}"
)


@query(
    "html_ids",
    f"SELECT i.file_id, name, 'web/' || lower(p_type) || '/p' || CAST(p_partkey AS VARCHAR) || '#' || name AS fqn, tag || '#' || name AS signature FROM ({PART_IDS}) i JOIN {{part}} ON p_partkey = i.file_id",
)
def html_ids(t: Tables) -> DataFrame:
    return extract.html_ids(t.markup_files).select("file_id", "name", "fqn", "signature")


@query(
    "custom_elements",
    "SELECT p_partkey AS file_id, 'part-card' AS callee_text, CAST(3 AS INTEGER) AS start_line, "
    "CAST(strlen('  <h2 id=>é </h2>') + strlen(p_type) + strlen(p_name) + 1 AS INTEGER) AS start_col FROM {part}",
)
def custom_elements(t: Tables) -> DataFrame:
    return extract.html_custom_elements(t.markup_files).select("file_id", "callee_text", "start_line", "start_col")


@query(
    "html_imports",
    "SELECT p_partkey AS file_id, '/js/' || lower(p_type) || '.js' AS ref_text FROM {part} UNION ALL SELECT p_partkey, '/css/' || p_brand || '.css' FROM {part} UNION ALL "
    "SELECT p_partkey, './m' || CAST(p_size AS VARCHAR) || '.js' FROM {part} UNION ALL SELECT p_partkey, 'dep' FROM {part}",
)
def html_imports(t: Tables) -> DataFrame:
    return extract.html_imports(t.markup_files).select("file_id", "ref_text")


@query(
    "inline_script_calls",
    "SELECT p_partkey AS file_id, unnest(['cart.add', 'price']) AS callee_text FROM {part}",
)
def inline_script_calls(t: Tables) -> DataFrame:
    return extract.inline_calls(t.markup_files).select("file_id", "callee_text")


@query(
    "inline_functions",
    "SELECT p_partkey AS file_id, 'web/' || lower(p_type) || '/p' || CAST(p_partkey AS VARCHAR) || '.show' AS fqn, 'show(a, b)' AS signature FROM {part}",
)
def inline_functions(t: Tables) -> DataFrame:
    return extract.inline_functions(t.markup_files).select("file_id", "fqn", "signature")


STYLE_NAMES = " UNION ALL ".join(
    f"SELECT c_custkey, '{kind}' AS kind, {name} AS name, {fqn} AS mark FROM {{customer}}"
    for kind, name, fqn in (
        ("class", "'cust-' || CAST(c_custkey AS VARCHAR)", "'.'"), ("class", "'wide'", "'.'"),
        ("id", "'row' || CAST(c_custkey AS VARCHAR)", "'#'"), ("variable", "'--bal'", "''"), ("variable", "'--seg'", "''"),
        ("keyframes", "'k' || CAST(c_nationkey AS VARCHAR)", "'@'"),
    )
)


@query(
    "css_symbols",
    f"SELECT n.c_custkey AS file_id, kind, name, 'css/' || lower(c_mktsegment) || '/c' || CAST(n.c_custkey AS VARCHAR) || mark || name AS fqn FROM ({STYLE_NAMES}) n JOIN {{customer}} c ON c.c_custkey = n.c_custkey",
)
def css_symbols(t: Tables) -> DataFrame:
    return extract.css_symbols(t.style_files).select("file_id", "kind", "name", "fqn")


def place_sql(needle: str) -> str:
    """Line and bytes of the first occurrence of a text in ``content``."""
    before = f"substr(content, 1, strpos(content, {needle}) - 1)"
    return (
        f"CAST(len({before}) - len(replace({before}, chr(10), '')) + 1 AS INTEGER) AS start_line, "
        f"CAST(strlen({before}) AS BIGINT) AS start_byte, CAST(strlen({before}) + strlen({needle}) AS BIGINT) AS end_byte"
    )


STYLE_PLACES = " UNION ALL ".join(
    f"SELECT file_id, '{kind}' AS kind, {place_sql(needle)} FROM {{style_files}} JOIN {{customer}} ON c_custkey = file_id"
    for kind, needle in (
        ("class", "'.cust-' || CAST(c_custkey AS VARCHAR)"), ("class", "'a.wide'"), ("id", "'#row' || CAST(c_custkey AS VARCHAR)"), ("variable", "'--bal: 1'"),
        ("variable", "'--seg: ' || lower(c_mktsegment)"), ("keyframes", "substr(content, strpos(content, '@keyframes'))"),
    )
)


@query("css_places", STYLE_PLACES)
def css_places(t: Tables) -> DataFrame:
    return extract.css_symbols(t.style_files).select("file_id", "kind", "start_line", "start_byte", "end_byte")


@query(
    "css_deep_rules",
    " UNION ALL ".join(
        f"SELECT file_id, {name} AS name, {place_sql(needle)} FROM {{deep_styles}}"
        for name, needle in (
            ("'d' || CAST(file_id AS VARCHAR)", "'.d' || CAST(file_id AS VARCHAR)"),
            ("'--n' || CAST(file_id AS VARCHAR)", "'--n' || CAST(file_id AS VARCHAR) || ': 1'"), ("'end'", "'#end'"),
        )
    ),
)
def css_deep_rules(t: Tables) -> DataFrame:
    return extract.css_symbols(t.deep_styles).select("file_id", "name", "start_line", "start_byte", "end_byte")


TRACK, LATE = "'track(' || CAST(file_id AS VARCHAR) || ')'", "'late(1)'"
CALL_OWNERS = (
    f"SELECT file_id, 'track' AS callee_text, 'p' || CAST(file_id AS VARCHAR) AS caller, {place_sql(TRACK)} FROM {{scripted_pages}} "
    f"UNION ALL SELECT file_id, 'late', NULL, {place_sql(LATE)} FROM {{scripted_pages}}"
)


@query("page_call_owners", CALL_OWNERS)
def page_call_owners(t: Tables) -> DataFrame:
    """From pages to the functions that hold their scripts' calls."""
    files = t.scripted_pages
    at = F.shiftleft(F.col("file_id"), 32) + F.col("start_byte")
    functions = extract.inline_functions(files).withColumn("id", at)
    calls = extract.inline_calls(files).withColumns({"id": at, "caller": F.lit(None).cast("long")})
    owners = functions.select(F.col("id").alias("caller"), F.col("name").alias("owner"))
    found = spans.attribute_callers(calls, functions).join(owners, "caller", "left")
    return found.select("file_id", "callee_text", F.col("owner").alias("caller"), "start_line", "start_byte", "end_byte")


@query(
    "css_imports",
    "SELECT c_custkey AS file_id, 'base' || CAST(c_nationkey AS VARCHAR) || '.css' AS ref_text FROM {customer} UNION ALL SELECT c_custkey, 't.css' FROM {customer}",
)
def css_imports(t: Tables) -> DataFrame:
    return extract.css_imports(t.style_files).select("file_id", "ref_text")


@query("style_bodies", "SELECT page_id AS file_id, unnest(regexp_extract_all(html, '<style>(.*?)</style>', 1, 's')) AS content FROM {pages}")
def style_bodies(t: Tables) -> DataFrame:
    return extract.style_bodies(t.page_files).select("file_id", "content")


@query(
    "first_imports",
    "SELECT o_custkey AS file_id, 'part' || CAST(l_partkey AS VARCHAR) AS ref_text, min(l_orderkey * 8 + l_linenumber) AS pos FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1, 2",
)
def first_imports(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit(1).alias("repo_id"), F.col("o_custkey").alias("file_id"), F.concat(F.lit("part"), "l_partkey").alias("ref_text"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
    )
    return extract.first_imports(rows).drop("repo_id")


def heading_extractor(content: str, path: str, repo_id: int) -> dict:
    """Headings in a page: every ``<h1>`` text becomes a symbol; no heading is an error."""
    import re

    found = re.findall(r"<h1>(.*?)</h1>", content, re.S)
    if not found:
        raise ValueError("no heading")
    return {"symbols": [{"kind": "heading", "name": h, "fqn": f"{path}#{i}"} for i, h in enumerate(found)]}


@query(
    "plugin_extractor",
    "WITH h AS (SELECT page_id, regexp_extract_all(html, '<h1>(.*?)</h1>', 1, 's') AS names FROM {pages}) "
    "SELECT 'site/p' || CAST(page_id AS VARCHAR) || '.html' AS path, CAST(len(names) AS BIGINT) AS n_symbols, CASE WHEN len(names) = 0 THEN 'ValueError: no heading' END AS parse_error FROM h",
)
def plugin_extractor(t: Tables) -> DataFrame:
    files = t.page_files.withColumn("lang", F.lit("html"))
    return plugin.extract_files(files, {"html": heading_extractor}).select(
        "path", F.size("symbols").cast("long").alias("n_symbols"), "parse_error"
    )
