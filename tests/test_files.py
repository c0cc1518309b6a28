"""Discovery, extraction, incremental maintenance, export and the indexing loop."""

import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import names, paths, text
from loomgraph.operators import brackets, extract, incremental as inc, plugin, resolve
from loomgraph.plans.fixtures import MADE_TEXTS, load
from loomgraph.sources import export, files as fs, tables
from loomgraph.streaming import indexing


def write(root, path, body):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(body)


# --- discovery -----------------------------------------------------------------------

def test_scan_and_discover(spark, tmp_path):
    root = str(tmp_path)
    for path in ("main.go", "web/app.TSX", "web/x.mjs", "vendor/v.go", "a/.hid/h.go", "draft_1.go", "draft_final.go", "old/deep/draft_2.go", "sub/README.md", "build/gen.java"):
        write(root, path, f"// {path}")
    scan = fs.scan_files(spark, root)
    lines = spark.createDataFrame(
        [(1, 0, "draft_*.go"), (1, 1, "!draft_final.go"), (1, 2, "/build"), (1, 3, "!build/gen.java"), (1, 4, " # no")],
        "repo_id long, ord long, line string",
    )
    got = {r.path: r.lang for r in fs.discover(scan, lines).collect()}
    assert got == {"main.go": "go", "web/app.TSX": "typescript", "web/x.mjs": "javascript", "draft_final.go": "go"}
    assert {r.path for r in fs.discover(scan, lines, fs.parse_langs("GO,")).collect()} == {"main.go", "draft_final.go"}
    hidden = {"_app.js", "_lib/util.go", ".eslintrc.js", "css/_vars.css", ".git/config"}
    for path in hidden:
        write(root, path, "x")
    assert hidden <= {r.path for r in fs.scan_files(spark, root, content=False).collect()}
    assert {r.path for r in fs.discover(fs.scan_files(spark, f"file:{root}"), lines).collect()} >= hidden - {".git/config"}
    row = scan.where("path = 'main.go'").select("size", fs.sha256_hex("content").alias("sha")).first()
    assert row["size"] == 10 and len(row.sha) == 64


@pytest.mark.parametrize(("rule", "path", "hit"), [
    ("*.log", "a/b/x.log", True), ("*.log", "x.logs", False), ("/top", "top/x", True), ("/top", "a/top", False),
    ("docs/*.md", "docs/a.md", True), ("docs/*.md", "docs/sub/a.md", False), ("tmp/", "a/tmp/b", True),
    ("[ab]?.c", "ax.c", True), ("[^ab]?.c", "ax.c", False), ("[", "[", False), ("a\\*b", "a*b", True), ("d[0-9]", "d5", True),
])
def test_ignore_patterns(spark, rule, path, hit):
    lines = spark.createDataFrame([(1, 0, rule)], "repo_id long, ord long, line string")
    df = spark.createDataFrame([(1, path)], "repo_id long, path string")
    assert (fs.filter_ignored(df, fs.ignore_rules(lines)).count() == 0) == hit


def test_listing_skips_links_ignored_and_unreadable(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for path in ("a/x.go", "gone/deep/y.go", "gone/kept.go", "vendor/v.go", ".hid/h.go", "b/.dot.go", "b/node/z.js", "node/deep/w.js"):
        write(root, path, "x")
    os.symlink("..", os.path.join(root, "a/up"))
    os.symlink("x.go", os.path.join(root, "a/same.go"))
    os.symlink("nowhere", os.path.join(root, "a/broken.go"))
    os.symlink("loop.go", os.path.join(root, "a/loop.go"))
    files, unreadable = fs.list_tree(spark, root)
    assert {r.path for r in files.collect()} == {"a/x.go", "a/same.go", "gone/deep/y.go", "gone/kept.go", "vendor/v.go", ".hid/h.go", "b/.dot.go", "b/node/z.js", "node/deep/w.js"}
    assert unreadable.count() == 0
    listed = []
    write_table = fs.materialize
    monkeypatch.setattr(fs, "materialize", lambda df, name: (lambda out: (listed.append(out) if name == "listed" else None, out)[1])(write_table(df, name)))
    ignore = ["gone/", "!gone/kept.go", "/node", "# none"]
    got = fs.scan_sources(spark, root, 4, ignore, ["go", "javascript"])
    assert {(r.repo_id, r.path, r.lang, bytes(r.content)) for r in got.collect()} == {
        (4, p, lang, b"x") for p, lang in (("a/x.go", "go"), ("a/same.go", "go"), ("b/.dot.go", "go"), ("b/node/z.js", "javascript"))
    }
    seen = {r.path for level in listed for r in level.collect()}
    assert not any(p.startswith(("gone", "node", "vendor", ".hid")) for p in seen)
    odd = spark.createDataFrame([("a/loop.go",), ("a/broken.go",), ("a",), ("a/x.go",)], "path string")
    assert [r.path for r in fs.read_contents(odd, root).collect()] == ["a/x.go"]
    _, missing = fs.list_tree(spark, root + "/nothing-here")
    assert [(r.path, r.error.split(":")[0]) for r in missing.collect()] == [("", "FileNotFoundError")]


def test_go_module(spark):
    rows = [(1, "go.mod", "// c\nmodule  example.org/x \ngo 1.25"), (1, "a.go", ""), (2, "a.go", ""), (3, "sub/go.mod", "module y")]
    df = spark.createDataFrame(rows, "repo_id long, path string, content string")
    assert {r.repo_id: r.module for r in fs.go_module(df).collect()} == {1: "example.org/x", 2: "unknown", 3: "unknown"}


# --- markup -----------------------------------------------------------------------------

def page(spark, body, path="pages/index.html"):
    return spark.createDataFrame([(1, 2, path, body)], "repo_id long, file_id long, path string, content string")


def test_html_ids_with_places(spark):
    body = '<html><body>\n<!-- <p id="no"> -->\n  é<div id="hero" data-id="x"></div><b id=foot title="id=z"></b>\n<i id=""></i></body></html>'
    rows = {r["name"]: r for r in extract.html_ids(page(spark, body)).collect()}
    assert set(rows) == {"hero", "foot"}
    hero = rows["hero"]
    raw = body.encode()
    at = raw.index(b'<div id="hero"')
    assert (hero.fqn, hero.signature, hero.start_line, hero.start_col) == ("pages/index#hero", "div#hero", 3, 5)
    assert raw[hero.start_byte:hero.end_byte] == b'<div id="hero" data-id="x">' and hero.start_byte == at


def test_html_imports_and_calls(spark):
    body = (
        '<head><link href="themes/night.css" rel="stylesheet"><script defer src="lib/_boot.js"></script><script src=\'lib/_boot.js\'></script></head>'
        "<date-picker>x</date-picker><side-bar/><section><em></em></section>"
        "<script>import { a, b } from '../util/pairs.mjs'; import 'polyfill'; const q = require(\"queue/fast\");\n"
        "function load(u) { window.fetch('no(1)'); while (u) { step(next(u)); } } // gone()\n load(); new Widget();</script>"
    )
    df = page(spark, body)
    assert {r.ref_text for r in extract.html_imports(df).collect()} == {"themes/night.css", "lib/_boot.js", "../util/pairs.mjs", "polyfill", "queue/fast"}
    assert {r.callee_text for r in extract.html_custom_elements(df).collect()} == {"date-picker", "side-bar"}
    assert sorted(r.callee_text for r in extract.inline_calls(df).collect()) == ["load", "next", "step", "window.fetch"]
    assert [(r["name"], r.fqn, r.signature) for r in extract.inline_functions(df).collect()] == [("load", "pages/index.load", "load(u)")]


def test_css(spark):
    body = (
        "@import 'a.css'; @import url(\"b.css\"); /* .no { } */ .btn, #main, div.card, ul .deep, a:hover { --x: 1; color: red }\n"
        "@media print { .print { --y: 2 } } @-webkit-keyframes spin { from { top: 0 } to { top: 1 } } p { margin: 0 }"
    )
    df = page(spark, body, "css/site.css")
    got = {(r.kind, r["name"], r.fqn) for r in extract.css_symbols(df).collect()}
    assert got == {
        ("class", "btn", "css/site.btn"), ("id", "main", "css/site#main"), ("class", "card", "css/site.card"),
        ("variable", "--x", "css/site--x"), ("class", "print", "css/site.print"), ("variable", "--y", "css/site--y"),
        ("keyframes", "spin", "css/site@spin"),
    }
    assert {r.ref_text for r in extract.css_imports(df).collect()} == {"a.css", "b.css"}


def test_nested_css_rules(spark):
    body = (
        ".outer { --v: 1; .inner { --w: 2; .deep { top: 0 } } --z: 3 }\n#quoted { --q: '{'; content: \"}\" }\n"
        "@media print { .card { .title { --t: 1 } } }\n.after { }"
    )
    got = {(r.kind, r["name"]) for r in extract.css_symbols(page(spark, body, "a.css")).collect()}
    assert got == {
        ("class", "outer"), ("class", "inner"), ("class", "deep"), ("id", "quoted"), ("class", "card"), ("class", "title"), ("class", "after"),
        ("variable", "--v"), ("variable", "--w"), ("variable", "--z"), ("variable", "--q"), ("variable", "--t"),
    }


def places(rows, body):
    raw = body.encode()
    return [(r["name"] if "name" in r else r.callee_text, r.start_line, r.start_col, r.end_line, raw[r.start_byte : r.end_byte].decode()) for r in rows]


def test_css_places_at_any_depth(spark):
    body = (
        "/* é{ */ .btn, #main,\n  div.card, ul .deep { --x: '}'; color: red; --y: 2 } }\n"
        "@keyframes spin {\n from { --no: 1 } }\n" + "".join(f".l{i} {{ " for i in range(40)) + "--z: 1" + "}" * 40 + " .late { a: url(x;y{); --w:0 } .open { --u: 1"
    )
    got = places(extract.css_symbols(page(spark, body, "a.css")).collect(), body)
    assert got[:5] == [
        ("btn", 1, 11, 1, ".btn"), ("main", 1, 17, 1, "#main"), ("card", 2, 3, 2, "div.card"), ("--x", 2, 24, 2, "--x: '}'"), ("--y", 2, 46, 2, "--y: 2"),
    ]
    assert got[5] == ("spin", 3, 1, 4, "@keyframes spin {\n from { --no: 1 } }")
    assert [g[0] for g in got[6:]] == [f"l{i}" for i in range(40)] + ["--z", "late", "--w", "open", "--u"]
    assert got[46][4] == "--z: 1" and all(g[4] == f".l{i}" for i, g in enumerate(got[6:46]))
    empty = spark.createDataFrame([(1, 1, "a.css", None), (1, 2, "b.css", "")], "repo_id long, file_id long, path string, content string")
    assert extract.css_symbols(empty).count() == 0 and extract.inline_calls(empty).count() == 0 and extract.inline_functions(empty).count() == 0


def test_script_places(spark):
    body = (
        "<p>é</p>\n<script>function f(a, b = 'x)é') {\n if (a) { g.h(b,\n i(a)); } } // no(1)\n"
        "  function  g2 ({q}, r) { f(`}`) }  f ( 1 ); new W(x(1)) </script><script src='a.js'>zz()</script>\n <SCRIPT>k()</SCRIPT><!-- <script>c()</script> -->"
    )
    files = page(spark, body, "p.html")
    assert sorted(places(extract.inline_calls(files).collect(), body)) == [
        ("f", 5, 27, 5, "f(`}`)"), ("f", 5, 37, 5, "f ( 1 )"), ("g.h", 3, 11, 4, "g.h(b,\n i(a))"), ("i", 4, 2, 4, "i(a)"), ("k", 6, 10, 6, "k()"), ("x", 5, 52, 5, "x(1)"),
    ]
    found = extract.inline_functions(files).collect()
    assert sorted(places(found, body)) == [
        ("f", 2, 9, 4, "function f(a, b = 'x)é') {\n if (a) { g.h(b,\n i(a)); } }"), ("g2", 5, 3, 5, "function  g2 ({q}, r) { f(`}`) }"),
    ]
    assert sorted(r.signature for r in found) == ["f(a, b = 'x)é')", "g2({q}, r)"]


def test_brackets_are_paired_without_a_shuffle(spark):
    css, html = page(spark, ".a { --b: 1 }", "a.css"), page(spark, "<script>function f(a) { g(a) }</script>", "p.html")
    for found in (extract.css_symbols(css), extract.inline_functions(html), extract.inline_calls(html)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
    body = "} { a; } ) x [ ( } y { é\n; z"
    rows = brackets.pieces(page(spark, body), extract.FILE_KEY, "content", "(){}[];").collect()
    assert [(r.pos, r.piece, r.mark, r.level, r.block, r.close and tuple(r.close), r.head and r.head.mark, r.start_line, r.start_col) for r in rows] == [
        (0, "}", "}", 0, None, None, None, 1, 1), (1, " {", "{", 0, None, (8, 1), None, 1, 2), (2, " a;", ";", 0, 1, None, None, 1, 4), (3, " }", "}", 0, 1, None, None, 1, 7),
        (4, " )", ")", -1, None, None, None, 1, 9), (5, " x [", "[", -1, None, (29, 2), None, 1, 11), (6, " (", "(", 0, None, (18, 1), None, 1, 15),
        (7, " }", "}", 0, 6, None, None, 1, 17), (8, " y {", "{", 0, None, (29, 2), "}", 1, 19), (9, " é\n;", ";", 0, 8, None, None, 1, 23), (10, " z", None, 0, 8, None, None, 2, 2),
    ]


def test_made_texts_are_dealt_to_all_cores(spark):
    assert all(load(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism for name in MADE_TEXTS)


def test_types_without_an_own_name_are_resolved(spark):
    rows = [("A", None, "p", None), ("B", None, "p", "p.B"), ("C", "q.C", "p", "p.X")]
    df = spark.createDataFrame(rows, "type_name string, imported string, package string, src_fqn string")
    assert {r.type_name: r.resolved for r in names.resolve_types(df).collect()} == {"A": "p.A", "C": "q.C"}


def test_name_functions(spark):
    row = spark.range(1).select(
        names.split_top_level(F.lit("Box<Pair<A, B>>,Row.Cell<X, List<Y>> , , Marker")).alias("parts"),
        names.strip_generics(F.lit(" List<String>[] [] ")).alias("stripped"),
        names.import_package(F.lit("import static a.b.C.d;")).alias("static"),
        paths.module_name(F.lit("index.html")).alias("module"),
        paths.parse_locations(F.lit("null")).alias("none"),
        text.parse_rfc3339(F.lit("yesterday")).alias("bad"),
        names.is_identifier(F.lit("1a")).alias("ident"),
    ).first()
    assert row.parts == ["Box<Pair<A, B>>", "Row.Cell<X, List<Y>>", "Marker"]
    assert (row.stripped, row.static, row.module, row.none, row.bad, row.ident) == ("List[][]", None, "index", [], None, False)


# --- incremental ----------------------------------------------------------------------------

FILE = "repo_id long, path string, sha256 string, mtime long"


def test_change_status(spark):
    prior = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 1), (1, "c", "x", 1), (1, "d", "x", 1)], FILE)
    now = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 1), (1, "c", "x", 2), (1, "e", "x", 1)], FILE)
    got = {r.path: r.status for r in inc.change_status(prior, now).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "changed", "e": "new"}
    assert [r.path for r in inc.stale_files(prior, now).collect()] == ["d"]


def test_symbol_upsert_keeps_first_language_and_all_without_fqn(spark):
    schema = "id long, repo_id long, kind string, fqn string, lang string, name string"
    old = spark.createDataFrame([(1, 1, "function", "a.f", "go", "old"), (9, 1, "function", None, "go", "n")], schema)
    new = spark.createDataFrame(
        [(5, 1, "function", "a.f", "java", "late", "p2"), (6, 1, "function", "a.f", "java", "early", "p1"), (7, 1, "function", None, "go", "n", "p1")],
        schema + ", path string",
    )
    got = sorted((r.id, r.lang, r["name"]) for r in inc.upsert_symbols(old, new, ["path"]).collect())
    assert got == [(1, "go", "late"), (7, "go", "n"), (9, "go", "n")]


def test_resolve_reads_json_answers(spark):
    files = spark.createDataFrame([(1, 1, "a.java", "java")], "id long, repo_id long, path string, lang string")
    symbols = spark.createDataFrame(
        [(10, 1, 1, "class", "C", 1, 20), (11, 1, 1, "interface", "I", 30, 40), (12, 1, 1, "method", "m", 5, 6)],
        "id long, repo_id long, file_id long, kind string, name string, start_line int, end_line int",
    )
    raw = '[{"uri":"file:///w/a.java","range":{"start":{"line":30,"character":0}}}]'
    answers = resolve.read_locations(spark.createDataFrame([(10, 11, raw), (11, 5, "null")], "symbol_id long, parent_kind int, raw string"), "/w")
    got = resolve.hierarchy_edges(answers, symbols, files, "jdtls").collect()
    assert [(r.kind, r.src, r.dst) for r in got] == [("IMPLEMENTS", 10, 11)]


def test_user_resolver(spark):
    files = spark.createDataFrame([(1, 1, "a.go")], "id long, repo_id long, path string")
    symbols = spark.createDataFrame(
        [(10, 1, 1, "f", 1, 9), (11, 1, 1, "target", 20, 30), (12, 1, 1, "byname", 40, 41)],
        "id long, repo_id long, file_id long, name string, start_line int, end_line int",
    )
    calls = spark.createDataFrame(
        [(1, 1, 10, "x.target", None), (2, 1, None, "target", None), (3, 1, 10, "pkg.byName", None), (4, 1, 10, "old", 99), (5, 1, 10, "late", None)],
        "id long, repo_id long, caller long, callee_text string, resolved long",
    )
    lines = {1: 25, 2: 25, 3: 500}

    def resolver(work):
        assert [r.id for r in work.orderBy("id").collect()] == [1, 2, 3]
        return spark.createDataFrame([(i, "a.go", n) for i, n in lines.items()], "callsite_id long, path string, line int")

    after, edges = resolve.run_resolver(resolver, calls, symbols, files, "gopls", budget=3)
    assert {r.id: r.resolved for r in after.collect()} == {1: 11, 2: 11, 3: 12, 4: 99, 5: None}
    assert {(r.src, r.dst, r.confidence, r.provenance) for r in edges.collect()} == {(10, 11, 1.0, "gopls"), (10, 12, 1.0, "gopls")}


# --- export -------------------------------------------------------------------------------------

def test_graphml_is_one_document(spark, tmp_path):
    nodes = spark.createDataFrame([(2, "go", "function", 'a<"b">', None), (1, "go", "type", "t", "p.t")], "id long, lang string, kind string, name string, fqn string")
    edges = spark.createDataFrame([(1, "CALLS", 2, 1)], "repo_id long, kind string, src long, dst long")
    out = str(tmp_path / "g")
    export.export_graphml(nodes, edges, "r&d", out)
    body = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    root = ET.fromstring(body)
    ns = "{http://graphml.graphdrawing.org/graphml}"
    graph = root.find(ns + "graph")
    assert graph.get("id") == "r&d" and [n.get("id") for n in graph.findall(ns + "node")] == ["n1", "n2"]
    assert [d.text for d in graph.findall(ns + "node")[1]] == ["function", 'a<"b">', None, "go"]
    edge = graph.find(ns + "edge")
    assert (edge.get("source"), edge.get("target"), edge[0].text) == ("n2", "n1", "CALLS")
    export.export_json(nodes.withColumns({"signature": F.lit(""), "visibility": F.lit("public"), "start_line": F.lit(3)}),
                       edges.withColumns({"confidence": F.lit(0.4), "provenance": F.lit("x")}), "r", out + "j")
    first = spark.read.json(out + "j/nodes").orderBy("id").first()
    assert first["name"] == "t" and "signature" not in first


# --- the indexing loop ----------------------------------------------------------------------------

def toy_extractor(content, path, repo_id):
    """Lines ``def NAME: CALLEE ...`` are functions of the file's package."""
    if "broken" in content:
        raise ValueError("broken file")
    pkg = os.path.dirname(path) or "root"
    out = {"src_pkg_fqn": pkg, "symbols": [{"kind": "package", "name": pkg, "fqn": pkg}], "callsites": [], "imports": [], "type_refs": []}
    at = 0
    for line in content.splitlines(True):
        if line.startswith("def "):
            head, _, body = line[4:].partition(":")
            out["symbols"].append({"kind": "function", "name": head, "fqn": f"{pkg}.{head}", "start_byte": at, "end_byte": at + len(line),
                                   "start_line": 1, "end_line": 1})
            for word in body.split():
                out["callsites"].append({"callee_text": word, "start_byte": at + 1, "end_byte": at + 2, "confidence": 0.9, "provenance": "toy"})
        elif line.startswith("import "):
            out["imports"].append(line.split()[1])
        at += len(line)
    return out


def graph_of(spark, base):
    symbols = tables.read_table(spark, base, "symbols").select("id", "fqn", "kind")
    edges = tables.read_table(spark, base, "edges")
    a, b = symbols.toDF("src", "s", "k1"), symbols.toDF("dst", "d", "k2")
    return {(r.kind, r.s, r.d) for r in edges.join(a, "src").join(b, "dst").collect()}, {r.fqn for r in symbols.collect()}


def test_incremental_index_equals_full_rebuild(spark, tmp_path):
    root, base = str(tmp_path / "src"), str(tmp_path / "kg")
    write(root, "a/x.go", "import b\ndef one: x.two three\n")
    write(root, "a/y.go", "def three: one\n")
    write(root, "b/z.go", "def two: nothing\n")
    write(root, "b/bad.go", "broken")
    extractors = {"go": toy_extractor}
    first = indexing.index_once(spark, base, fs.scan_files(spark, root), extractors).first()
    assert (first.indexed, first.unchanged, first.errors) == (4, 0, 0)
    edges, fqns = graph_of(spark, base)
    assert {("CALLS", "a.one", "b.two"), ("CALLS", "a.one", "a.three"), ("CALLS", "a.three", "a.one"), ("IMPORTS", "a", "b"),
            ("DECLARES", "a", "a.one")} <= edges
    again = indexing.index_once(spark, base, fs.scan_files(spark, root), extractors).first()
    assert (again.indexed, again.unchanged) == (0, 4) and graph_of(spark, base) == (edges, fqns)
    write(root, "b/z.go", "def two: one\ndef four: two\n")
    os.remove(os.path.join(root, "a/y.go"))
    change = indexing.index_once(spark, base, fs.scan_files(spark, root), extractors).first()
    assert (change.indexed, change.unchanged) == (1, 2)
    fresh = str(tmp_path / "full")
    indexing.index_once(spark, fresh, fs.scan_files(spark, root), extractors, full=True)
    assert graph_of(spark, base) == graph_of(spark, fresh)
    assert "a.three" not in graph_of(spark, base)[1]
    bad = plugin.extract_files(fs.with_lang(fs.scan_files(spark, root)).withColumn("content", F.col("content").cast("string")), extractors)
    assert [r.parse_error for r in bad.where("path = 'b/bad.go'").collect()] == ["ValueError: broken file"]


def test_web_files_need_no_extractor(spark, tmp_path):
    root, base = str(tmp_path / "src"), str(tmp_path / "kg")
    write(root, "w/a.html", '<p id="top">x</p><my-box></my-box><script>function go(a) { step(a) } function step(b) { }</script>')
    write(root, "w/a.css", ".btn { --x: 1 }")
    done = indexing.index_once(spark, base, fs.scan_files(spark, root), {}).first()
    assert (done.indexed, done.symbols, done.callsites, done.errors) == (2, 5, 2, 0)
    symbols = tables.read_table(spark, base, "symbols").collect()
    assert {(r.lang, r.kind, r.fqn) for r in symbols} == {
        ("html", "id", "w/a#top"), ("javascript", "function", "w/a.go"), ("javascript", "function", "w/a.step"), ("css", "class", "w/a.btn"), ("css", "variable", "w/a--x"),
    }
    assert all(r.start_byte < r.end_byte for r in symbols)
    assert ("CALLS", "w/a.go", "w/a.step") in graph_of(spark, base)[0]


def test_row_callback(spark):
    total = spark.sparkContext.accumulator(0)
    plugin.for_each_row(spark.range(10), lambda row: total.add(row.id))
    assert total.value == 45


def test_streamed_index_equals_batch(spark, tmp_path):
    root, base, whole = str(tmp_path / "src"), str(tmp_path / "kg"), str(tmp_path / "whole")
    for i in range(4):
        write(root, f"p{i % 2}/f{i}.go", f"def fn{i}: fn{(i + 1) % 4}\n")
    extractors = {"go": toy_extractor}
    stream = fs.stream_files(spark, root, files_per_batch=2)
    indexing.start(stream, base, str(tmp_path / "ckpt"), extractors, available_now=True).awaitTermination()
    indexing.index_once(spark, whole, fs.scan_files(spark, root), extractors)
    assert graph_of(spark, base) == graph_of(spark, whole)


def test_emptied_table_replaces_the_old_partition(spark, tmp_path):
    base = str(tmp_path)
    tables.create_tables(spark, base)
    edge = spark.createDataFrame([(1, "CALLS", 1, 2, 0.4, "x"), (2, "CALLS", 1, 2, 0.4, "x")], schemas.EDGES)
    repos = edge.select("repo_id").distinct()
    tables.write_tables({"edges": edge}, repos, base)
    tables.write_tables({"edges": edge.where("false")}, repos.where("repo_id = 1"), base)
    assert [r.repo_id for r in tables.read_table(spark, base, "edges").collect()] == [2]


def test_watch_follows_a_folder(spark, tmp_path):
    root, base = str(tmp_path / "src"), str(tmp_path / "kg")
    write(root, "p/_a.go", "def one: two\n")
    write(root, "p/.b.go", "def two: one\n")
    write(root, "skip/c.go", "def three: one\n")
    extractors, ignore = {"go": toy_extractor}, ["skip/"]

    def tick(n):
        indexing.watch(spark, root, base, str(tmp_path / f"ckpt{n}"), extractors, ignore_lines=ignore, every="1 second", ticks=1).awaitTermination()
        return graph_of(spark, base)

    assert tick(1)[1] == {"p", "p.one", "p.two"}
    os.remove(os.path.join(root, "p/_a.go"))
    write(root, "p/.b.go", "def two: four\ndef four: two\n")
    edges, fqns = tick(2)
    assert fqns == {"p", "p.two", "p.four"} and ("CALLS", "p.two", "p.four") in edges
    known = tables.read_table(spark, base, "files")
    again = fs.scan_sources(spark, root, 1, ignore, known=known).collect()
    assert [(r.path, r.content, r.sha256 is not None) for r in again] == [("p/.b.go", None, True)]
    assert tick(3) == (edges, fqns)


def test_generics_are_stripped_alike_with_and_without_brackets(spark):
    texts = ["Name", "a.B$1", " Map<String, List<X>> ", "X[]", " List<Y>[] [] ", "Z [ ]", "Q<T[]>", "é<T>", "", "A<B>\n", "A\n"]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "x string").select(names.strip_generics("x").alias("s"))
    assert [r.s for r in rows.collect()] == ["Name", "a.B$1", "Map", "X[]", "List[][]", "Z [ ]", "Q", "é", "", "A", "A", None]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN" in plan  # plain names don't meet the patterns
