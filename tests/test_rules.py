"""Edge rules on hand-written symbols."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import edges as edge_ops
from loomgraph.operators import rules, skew, spans, typerefs

SYMBOL = "id long, repo_id long, file_id long, lang string, kind string, name string, fqn string"
REF = "repo_id long, file_id long, src long, dst long, ref_text string, provenance string"
CALL = "repo_id long, caller long, callee_text string"
EDGE = "repo_id long, kind string, src long, dst long, confidence double, provenance string"


def table(spark, rows):
    return spark.createDataFrame([(i, 1, 1, *r) for i, r in rows], SYMBOL)


def pairs(df):
    return {(r.kind, r.src, r.dst) for r in df.collect()}


GO = [
    (1, ("go", "package", "pkg", "mod/pkg")),
    (2, ("go", "type", "MyType", "mod/pkg.MyType")),
    (3, ("go", "method", "DoWork", "mod/pkg.(MyType).DoWork")),
    (4, ("go", "interface", "MyIface", "mod/pkg.MyIface")),
    (5, ("go", "method", "Run", "mod/pkg.MyIface.Run")),
    (6, ("go", "field", "Count", "mod/pkg.MyType.Count")),
    (7, ("go", "function", "NewMyType", "mod/pkg.NewMyType")),
]


def test_go_structure(spark):
    got = pairs(rules.structural_edges(table(spark, GO)))
    assert {g for g in got if g[0] == "DECLARES"} == {("DECLARES", 1, 2), ("DECLARES", 1, 4), ("DECLARES", 1, 7)}
    assert {g for g in got if g[0] == "CONTAINS"} == {
        ("CONTAINS", 2, 3), ("CONTAINS", 4, 5), ("CONTAINS", 2, 6), ("CONTAINS", 1, 2), ("CONTAINS", 1, 4),
    }


def test_java_structure(spark):
    rows = [
        (1, ("java", "package", "com.example", "com.example")),
        (2, ("java", "class", "Greeter", "com.example.Greeter")),
        (3, ("java", "constructor", "Greeter", "com.example.Greeter#Greeter(String)")),
        (4, ("java", "method", "hello", "com.example.Greeter#hello():String")),
        (5, ("java", "field", "name", "com.example.Greeter.name")),
        (6, ("java", "interface", "Sayable", "com.example.Sayable")),
        (7, ("java", "method", "say", "com.example.Sayable#say():void")),
        (8, ("java", "record", "Point", "com.example.Point")),
    ]
    got = pairs(rules.structural_edges(table(spark, rows)))
    assert {g[1:] for g in got if g[0] == "CONTAINS"} == {(2, 3), (2, 4), (2, 5), (6, 7), (1, 2), (1, 6)}
    assert {g[1:] for g in got if g[0] == "DECLARES"} == {(1, 2), (1, 6), (1, 8)}


def test_rules_stay_inside_a_repository(spark):
    df = table(spark, GO).withColumn("repo_id", F.when(F.col("id") == 2, 2).otherwise(F.col("repo_id")))
    assert ("DECLARES", 1, 2) not in pairs(rules.structural_edges(df))


def test_script_structure(spark):
    rows = [
        (1, ("typescript", "enum", "Color", "src/a.Color")),
        (2, ("typescript", "enum_member", "Red", "src/a.Color.Red")),
        (3, ("typescript", "function", "outer", "src/a.outer")),
        (4, ("typescript", "arrow_function", "inner", "src/a.outer.inner")),
        (5, ("javascript", "class", "K", "src/b.K")),
        (6, ("javascript", "method", "go", "src/b.K.go")),
        (7, ("javascript", "arrow_function", "arrow", "src/b.K.arrow")),
        (8, ("typescript", "method", "m", "src/a.Color.m")),
    ]
    assert {g[1:] for g in pairs(rules.structural_edges(table(spark, rows)))} == {(1, 2), (3, 4), (5, 6)}


@pytest.mark.parametrize("salted", [False, True])
def test_calls(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(skew, "SMALL_BYTES", 0)
        monkeypatch.setattr(skew, "HOT_ROWS", 0)
    rows = [
        (1, ("go", "function", "caller", "p.caller")),
        (2, ("go", "function", "run", "p.run")),
        (3, ("java", "method", "run", "a.B#run():void")),
        (4, ("javascript", "arrow_function", "run", "x.run")),
        (5, ("typescript", "arrow_function", "run", "y.run")),
        (6, ("go", "function", "b.c", "p.b.c")),
        (7, ("go", "function", "c", "p.c")),
        (8, ("go", "type", "run", "q.run")),
    ]
    calls = spark.createDataFrame([(1, 1, "run"), (1, 1, "x.run"), (1, 1, "a.b.c"), (1, None, "c")], CALL)
    df = table(spark, rows)
    assert pairs(rules.call_edges(df, calls)) == {("CALLS", 1, 2), ("CALLS", 1, 3), ("CALLS", 1, 5), ("CALLS", 1, 6)}
    assert pairs(rules.call_edges(df, calls, last_part=True)) == {("CALLS", 1, d) for d in (2, 3, 5, 7)}
    assert pairs(rules.call_edges(df, calls, same_lang=True)) == {("CALLS", 1, 2), ("CALLS", 1, 6)}


def test_implements_go_matches_brute_force(spark):
    rng = random.Random(11)
    sets = {i: {f"m{rng.randrange(6)}" for _ in range(rng.randrange(0, 5))} for i in range(1, 31)}
    rows, contains, next_id = [], [], 1000
    for owner, names in sets.items():
        rows.append((owner, ("go", "interface" if owner <= 12 else "type", f"T{owner}", f"p.T{owner}")))
        for name in names:
            rows.append((next_id, ("go", "method", name, f"p.{owner}.{name}")))
            contains.append((1, "CONTAINS", owner, next_id, 1.0, "extractor"))
            next_id += 1
    got = pairs(rules.implements_go_edges(table(spark, rows), spark.createDataFrame(contains, EDGE)))
    assert got == {
        ("IMPLEMENTS", t, i) for i in range(1, 13) for t in range(13, 31) if sets[i] and sets[i] <= sets[t]
    }


def test_java_hierarchy_and_overrides(spark):
    rows = [
        (1, ("java", "class", "A", "p.A")), (2, ("java", "interface", "I", "p.I")), (3, ("java", "class", "B", "p.B")),
        (11, ("java", "method", "run", "p.A#run():void")), (12, ("java", "method", "run", "p.I#run():void")),
        (13, ("java", "method", "run", "p.B#run(int):void")), (14, ("java", "method", "other", "p.I#other():void")),
    ]
    refs = spark.createDataFrame(
        [(1, 1, 1, None, "I", "implements-heuristic"), (1, 1, 1, None, "B", "extends-heuristic"), (1, 1, 1, None, "B", "implements-heuristic")],
        REF,
    )
    df = table(spark, rows)
    impl, ext = rules.implements_java_edges(df, refs), rules.extends_edges(df, refs)
    assert pairs(impl) == {("IMPLEMENTS", 1, 2)} and pairs(ext) == {("EXTENDS", 1, 3)}
    every = rules.structural_edges(df).unionByName(impl).unionByName(ext)
    assert pairs(rules.override_edges(df, every)) == {("OVERRIDES", 11, 12), ("OVERRIDES", 11, 13)}


def test_imports_once_even_if_repeated(spark):
    rows = [(1, ("go", "package", "a", "mod/a")), (2, ("go", "package", "b", "mod/b"))]
    refs = spark.createDataFrame([(1, 1, 1, None, "mod/b", "extractor")] * 2 + [(1, 1, None, None, "mod/b", "extractor")], REF)
    first = rules.import_edges(table(spark, rows), refs)
    assert pairs(first) == {("IMPORTS", 1, 2)}
    assert edge_ops.insert_or_ignore(first, first).count() == 1


def test_suffix_references(spark):
    rows = [
        (1, ("typescript", "function", "f", "a.f")), (2, ("typescript", "class", "Node", "src/x.Node")),
        (3, ("typescript", "interface", "Node", "src/y.ui.NODE")), (4, ("typescript", "function", "Node", "src/z.Node")),
        (5, ("javascript", "class", "Node", "src/w.Node")), (6, ("typescript", "class", "Bare", "Bare")),
        (7, ("typescript", "class", "xNode", "src/q.xNode")),
    ]
    refs = spark.createDataFrame(
        [(1, 1, 1, None, "Node", "type-ref"), (1, 1, 1, None, "ui.node", "type-ref"), (1, 1, 1, None, "Bare", "type-ref"),
         (1, 1, 1, None, "bare", "type-ref"), (1, 1, 2, None, "Node", "type-ref")],
        REF,
    )
    got = pairs(rules.reference_suffix_edges(table(spark, rows), refs))
    assert got == {("REFERENCES", 1, 2), ("REFERENCES", 1, 3), ("REFERENCES", 1, 6), ("REFERENCES", 2, 3)}


@pytest.mark.parametrize("salted", [False, True])
def test_smallest_span_matches_brute_force(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(skew, "SMALL_BYTES", 0)
        monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rng = random.Random(2)
    spans_, points = [], []
    for i in range(300):
        lo = rng.randrange(5000)
        spans_.append((1 if i % 3 else 2, i, lo, lo + rng.choice([0, 3, 15, 16, 17, 200, 3000])))
    for i in range(300):
        lo = rng.randrange(5200)
        points.append((1 if i % 4 else 2, i, lo, lo + rng.choice([0, 0, 5, 40])))
    got = spans.smallest_enclosing(
        spark.createDataFrame(points, "file_id long, point_id long, lo long, hi long"),
        spark.createDataFrame(spans_, "file_id long, span_id long, lo long, hi long"),
        ["file_id"],
    )
    want = {}
    for f, p, lo, hi in points:
        around = [(h - s, i) for g, i, s, h in spans_ if g == f and s <= lo and h >= hi]
        if around:
            want[p] = min(around)[1]
    assert {r.point_id: r.span_id for r in got.collect()} == want


def test_known_callers_stay(spark):
    symbols = spark.createDataFrame(
        [(7, 1, "function", 0, 100), (8, 1, "constructor", 10, 20)],
        "id long, file_id long, kind string, start_byte long, end_byte long",
    )
    calls = spark.createDataFrame(
        [(1, 1, 99, 12, 13), (2, 1, None, 12, 13), (3, 1, None, 200, 201)],
        "id long, file_id long, caller long, start_byte long, end_byte long",
    )
    assert {r.id: r.caller for r in spans.attribute_callers(calls, symbols).collect()} == {1: 99, 2: 7, 3: None}


# --- edge table ---------------------------------------------------------------------

def edge_rows(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], EDGE)


def test_semantic_upsert_needs_higher_confidence(spark):
    old = edge_rows(spark, ("CALLS", 1, 2, 0.4, "treesitter"), ("CALLS", 1, 3, 1.0, "jdtls"))
    new = edge_rows(spark, ("CALLS", 1, 2, 1.0, "gopls"), ("CALLS", 1, 3, 1.0, "gopls"), ("CALLS", 1, 4, 1.0, "gopls"))
    got = {(r.src, r.dst): r.provenance for r in edge_ops.semantic_upsert(old, new).collect()}
    assert got == {(1, 2): "gopls", (1, 3): "jdtls", (1, 4): "gopls"}


def test_strict_insert_refuses_duplicates(spark):
    old = edge_rows(spark, ("CALLS", 1, 2, 0.4, "a"))
    with pytest.raises(edge_ops.DuplicateEdges):
        edge_ops.strict_insert(old, edge_rows(spark, ("CALLS", 1, 2, 1.0, "b")))
    assert edge_ops.strict_insert(old, edge_rows(spark, ("CALLS", 2, 1, 1.0, "b"))).count() == 2


def test_rebuild_drops_only_its_family(spark):
    df = table(spark, [(1, ("java", "class", "A", "p.A")), (2, ("go", "type", "B", "q.B"))])
    old = edge_rows(spark, ("EXTENDS", 1, 2, 0.5, "heuristic"), ("EXTENDS", 1, 3, 1.0, "jdtls"), ("EXTENDS", 2, 1, 0.5, "heuristic"))
    got = edge_ops.rebuild(old, df, "EXTENDS", "heuristic", "java", edge_rows(spark, ("EXTENDS", 1, 4, 0.5, "heuristic")))
    assert {(r.src, r.dst) for r in got.collect()} == {(1, 3), (2, 1), (1, 4)}


def test_build_is_idempotent_and_takes_user_rules(spark):
    df = table(spark, GO)
    calls = spark.createDataFrame(
        [(1, 1, 1, None, "x.NewMyType", 5, 6)],
        "id long, repo_id long, file_id long, caller long, callee_text string, start_byte long, end_byte long",
    )
    symbols = df.withColumns({"start_byte": F.col("id") * 0, "end_byte": F.col("id") * 10})
    refs = spark.createDataFrame([], REF)
    rules.register_rule("tests", lambda s, c, r: edge_rows(spark, ("TESTS", 3, 2, 1.0, "user")))
    try:
        built = rules.build_edges(symbols, calls, refs)
        again = edge_ops.insert_or_ignore(built, rules.build_edges(symbols, calls, refs))
    finally:
        rules.unregister_rule("tests")
    got = pairs(built)
    assert ("CALLS", 3, 7) in got and ("TESTS", 3, 2) in got and len(got) == 10
    assert pairs(again) == got and again.count() == len(got)


def test_types_resolve_through_the_imports_of_their_file(spark):
    mention = "repo_id long, file_id long, src_fqn string, type_text string, package string"
    java = spark.createDataFrame(
        [(1, 1, "p.A", "List<B>", "p"), (1, 1, "p.A", "B", "p"), (1, 2, "p.A", "B", "p"), (1, 1, "p.A", "A", "p"), (1, 1, "p.A", "String", "p"), (1, 1, "p.A", "B[]", "p"), (1, 3, "X", "Y", None), (1, 1, "p.A", None, "p")],
        mention,
    )
    statements = spark.createDataFrame(
        [(1, 1, 1, "import q.B;"), (1, 1, 2, "import r.B;"), (1, 2, 1, "import static q.B;"), (1, 2, 2, "import q.*;"), (1, 1, 3, None)],
        "repo_id long, file_id long, pos long, text string",
    )
    got = {(r.file_id, r.src_fqn, r.ref_text) for r in typerefs.java_type_refs(java, statements).collect()}
    assert got == {(1, "p.A", "p.List"), (1, "p.A", "r.B"), (2, "p.A", "p.B"), (3, "X", "Y")}
    go = spark.createDataFrame(
        [(1, 1, "m.F", x, "m") for x in ("*sql.DB", "map[Key]log.Entry", "[N]T", "Pair[A, x.B]", "chan<- error", "dot.T", "F", None, "unknown.T", "func(a.B) string")], mention
    )
    aliases = spark.createDataFrame(
        [(1, 1, 1, None, "database/sql"), (1, 1, 2, "log", "x/zap"), (1, 1, 3, ".", "x/dot"), (1, 1, 4, "_", "x/un"), (1, 1, 5, "x", "y/old"), (1, 1, 6, "x", "y/new"), (1, 2, 1, "a", "z/a")],
        "repo_id long, file_id long, pos long, alias string, path string",
    )
    got = {r.ref_text for r in typerefs.go_type_refs(go, aliases).collect()}
    assert got == {"database/sql.DB", "m.Key", "x/zap.Entry", "m.T", "m.Pair", "m.A", "y/new.B"}


def test_calls_are_computed_once_and_only_where_callees_are(spark, monkeypatch):
    symbols = spark.createDataFrame(
        [(1, 1, "go", "function", "a"), (2, 1, "go", "function", "b"), (2, 1, "go", "function", "b"), (3, 2, "java", "method", "b"), (4, 2, "java", "class", "K")],
        "id long, repo_id long, lang string, kind string, name string",
    )
    calls = spark.createDataFrame([(1, 1, "x.b"), (1, 1, "y.b"), (2, 4, "x.b"), (3, 9, "x.b")], "repo_id long, caller long, callee_text string")
    stored = []
    monkeypatch.setattr(rules, "materialize", lambda df, name, keep=rules.materialize: stored.append(keep(df, name)) or stored[-1])
    assert [(r.src, r.dst) for r in rules.call_edges(symbols, calls, ["go"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in stored[0].select("repo_id", "src", "name").collect()] == [(1, 1, "b")]
    assert rules.call_edges(symbols, calls, ["typescript"]).count() == 0


def test_calls_of_one_name_are_dealt_out_by_their_pairs(spark):
    """1500 callers and 1500 functions of one name are few bytes, but more pairs than one task should make."""
    symbols = spark.range(1500).selectExpr("id", "1L AS repo_id", "'javascript' AS lang", "'function' AS kind", "'f' AS name", "concat('m', id, '.f') AS fqn")
    calls = spark.range(1500).selectExpr("1L AS repo_id", "id AS caller", "'x.f' AS callee_text").union(spark.sql("SELECT 1L, 7L, 'x.alone'"))
    edges = rules.call_edges(symbols, calls)
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1500 * 1500 and max(sizes) < 1_500_000
    assert edges.select("src", "dst").distinct().count() == 1500 * 1500
