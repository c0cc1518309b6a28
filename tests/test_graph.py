"""Traversal, lookup and layout on small graphs, also against brute force."""

import math
import os
import random
from collections import defaultdict, deque

import pytest

from loomgraph.operators import lookup, skew, stats, traverse
from loomgraph.plans import graph_queries, registry
from loomgraph.session import INPUT_PER_PARTITION, fit_tasks, materialize, scratch_root

EDGE = "repo_id long, kind string, src long, dst long"
SYMBOL = "id long, repo_id long, lang string, kind string, name string, fqn string"


def symbols(spark, names, kind="function"):
    rows = [(i, 1, "go", kind, n, f"pkg.{n}") for i, n in enumerate(names, 1)]
    return spark.createDataFrame(rows, SYMBOL)


def edges(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], EDGE)


def ask(spark, *texts):
    return spark.createDataFrame([(1, t) for t in texts], "repo_id long, query string")


def walk(name, spark, names, rows, query, **kw):
    found = traverse.traverse(name, symbols(spark, names), edges(spark, rows), ask(spark, query), **kw)
    return {(r["name"], r.depth) for r in found.collect()}


def test_chain(spark):
    rows = [("CALLS", 1, 2), ("CALLS", 2, 3)]
    assert walk("callees", spark, ["Foo", "Bar", "Baz"], rows, "pkg.Foo") == {("Bar", 1), ("Baz", 2)}
    assert walk("callers", spark, ["Foo", "Bar", "Baz"], rows, "Baz", depth=1) == {("Bar", 1)}


def test_impact_follows_calls_and_references(spark):
    rows = [("CALLS", 1, 2), ("REFERENCES", 3, 2), ("IMPORTS", 4, 2)]
    assert walk("impact", spark, ["Foo", "Bar", "Baz", "Qux"], rows, "Bar") == {("Foo", 1), ("Baz", 1)}


@pytest.mark.parametrize(("name", "kind"), [("impls", "IMPLEMENTS"), ("overriders", "OVERRIDES")])
def test_type_traversals(spark, name, kind):
    assert walk(name, spark, ["Iface", "Impl"], [(kind, 2, 1)], "Iface") == {("Impl", 1)}


def test_missing_symbol_is_dropped(spark):
    assert walk("callees", spark, ["Foo"], [("CALLS", 1, 99)], "Foo") == set()


def test_cycle_and_start_excluded(spark):
    rows = [("CALLS", 1, 2), ("CALLS", 2, 1)]
    assert walk("callees", spark, ["A1", "B1"], rows, "A1") == {("B1", 1)}


def brute_bfs(rows, seed, depth, cap):
    out = defaultdict(set)
    for a, b in rows:
        out[a].add(b)
    seen, frontier, result = {seed}, [seed], []
    for d in range(1, depth + 1):
        fresh = sorted({b for a in frontier for b in out[a]} - seen)
        if cap is not None:
            fresh = fresh[:cap]
        seen |= set(fresh)
        result += [(d, x) for x in fresh]
        frontier = fresh
    return set(sorted(result)[:cap] if cap is not None else result)


@pytest.mark.parametrize(("cap", "salted"), [(None, False), (3, False), (7, True), (None, True)])
def test_bfs_matches_brute_force_with_a_hub(spark, monkeypatch, cap, salted):
    if salted:
        monkeypatch.setattr(skew, "SMALL_BYTES", 0)
        monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rng = random.Random(5)
    rows = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)} | {(0, i) for i in range(40)} | {(i, 0) for i in range(9)}
    df = edges(spark, [("CALLS", a, b) for a, b in rows])
    seeds = [1, 2, 3, 17]
    found = traverse.bfs(df, spark.createDataFrame([(s,) for s in seeds], "seed long"), depth=4, max_nodes=cap)
    got = defaultdict(set)
    for r in found.collect():
        got[r.seed].add((r.depth, r.id))
    for s in seeds:
        assert got[s] == brute_bfs(rows, s, 4, cap)


def test_bfs_defaults_for_non_positive_bounds(spark):
    rows = [("CALLS", i, i + 1) for i in range(1, 6)]
    found = traverse.bfs(edges(spark, rows), spark.createDataFrame([(1,)], "seed long"), depth=0, max_nodes=0)
    assert {r.id for r in found.collect()} == {2, 3, 4}


def test_tree_line(spark):
    df = spark.createDataFrame([(2, "method", "a.b")], "depth int, kind string, fqn string")
    assert traverse.tree_lines(df).first().line == "    [method] a.b"


# --- lookup ---------------------------------------------------------------------

def test_name_lookup_is_literal_and_case_insensitive(spark):
    df = symbols(spark, ["do_work", "doXwork", "DO_WORKER", "50%"])
    assert {r["name"] for r in lookup.by_name(df, "o_w").collect()} == {"do_work", "DO_WORKER"}
    assert {r["name"] for r in lookup.by_name(df, "0%").collect()} == {"50%"}


def test_contains_join_matches_brute_force(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abAB_") for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    needles = ["", "a", "B_", "aba", "bab_", "zz", "ABAB"]
    hay = spark.createDataFrame([(1, n) for n in names], "repo_id long, name string")
    got = {(r["query"], r["name"]) for r in lookup.contains_join(ask(spark, *needles), hay).collect()}
    assert got == {(q, n) for q in needles for n in names if q.lower() in n.lower()}


def test_contains_join_meets_names_under_whole_needles(spark, monkeypatch):
    met = []

    def spy(heavy, other, on, *rest, **options):
        joined = salted_join(heavy, other, on, *rest, **options)
        met.append(joined.count())
        return joined

    salted_join = lookup.salted_join
    monkeypatch.setattr(lookup, "salted_join", spy)
    names = [f"m{i}" for i in range(1000, 1200)]
    hay = spark.createDataFrame([(1, n) for n in names], "repo_id long, name string")
    for index in (None, lookup.index_names(hay)):
        assert {(r["query"], r["name"]) for r in lookup.contains_join(ask(spark, *names), hay, index=index).collect()} == {(n, n) for n in names}
    assert met == [200, 200]


def test_contains_join_of_long_and_repeated_texts(spark):
    stem = "a_long_common_beginning_of_"
    names = ["", "aaaa", "AaBaA", "é\U0010ffffx", *[f"{stem}{i}" for i in range(30)], stem, stem.upper() + "7_" + stem]
    needles = ["", "a", "aa", "aaa", "É", "é\U0010ffff", "_", stem, f"{stem}7", "common_beginning_of_2", stem + "_none", "beginning"]
    hay = spark.createDataFrame([(1, n) for n in names] + [(1, None), (2, "aa")], "repo_id long, name string")
    fold = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    want = sorted((q, n) for q in needles for n in names if fold(q) in fold(n))
    for index in (None, lookup.index_names(hay)):
        assert sorted((r["query"], r["name"]) for r in lookup.contains_join(ask(spark, *needles), hay, index=index).collect()) == want
    assert lookup.contains_join(ask(spark, "aa").where("false"), hay, index=lookup.index_names(hay)).count() == 0


def test_resolution_ladder(spark):
    rows = [
        (1, 1, "go", "function", "Run", "a.Run"),
        (2, 1, "go", "type", "Run", "b.Run"),
        (3, 1, "go", "function", "Runner", "a.Runner"),
        (4, 1, "go", "function", "Stop", "a.Stop"),
        (5, 1, "go", "method", "Stop", "a.(T).Stop"),
        (6, 1, "go", "type", "Only", "a.Only"),
        (7, 1, "go", "package", "Lone", "a.Lone"),
        (8, 1, "go", "function", "Loner", "a.Loner"),
    ]
    got = {
        r["query"]: (r.symbol_id, r.status)
        for r in lookup.resolve_names(
            spark.createDataFrame(rows, SYMBOL), ask(spark, "a.Runner", "Run", "Stop", "onl", "Lone", "nothing", "un")
        ).collect()
    }
    assert got == {
        "a.Runner": (3, "fqn"), "Run": (1, "callable"), "Stop": (None, "ambiguous"), "onl": (6, "single"),
        "Lone": (7, "exact"), "nothing": (None, "not_found"), "un": (None, "ambiguous"),
    }


def test_query_symbols_falls_back_from_fqn(spark):
    df = symbols(spark, ["Foo", "Bar", "Baz", "x.y"])
    got = {(r["query"], r["name"]) for r in lookup.query_symbols(df, ask(spark, "pkg.Foo", "Ba", "x.y")).collect()}
    assert got == {("pkg.Foo", "Foo"), ("Ba", "Bar"), ("Ba", "Baz"), ("x.y", "x.y")}


# --- skew helpers ----------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(60)], "k long, a long")
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (99, 13)], "k long, b long")
    plain = left.join(right, "k", how)
    salted = skew.salted_join(left, right, ["k"], how, hot_rows=5, salts=4, small_bytes=0)
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    if how == "inner":
        spread = skew.spread_join(left, right, ["k"], ["a"])
        assert sorted(map(str, spread.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


# --- layout -----------------------------------------------------------------------

def test_ring_layout_matches_a_direct_computation(spark):
    rng = random.Random(1)
    n = 130
    rows = [("CALLS", rng.randrange(n), rng.randrange(20)) for _ in range(300)]
    nodes = spark.range(n).selectExpr("id")
    got = {r.id: r for r in stats.ring_layout(nodes, edges(spark, rows)).collect()}
    degree = [0] * n
    for _, a, b in rows:
        degree[a] += 1
        degree[b] += 1
    order = sorted(range(n), key=lambda i: (-degree[i], i))
    start, previous = 0, 0.0
    for ring, fraction in enumerate((0.05, 0.15, 0.35, 1.0)):
        end = math.ceil(fraction * n)
        members = order[start:end]
        radius = max(60.0 if ring == 0 else previous + 70, 60.0 if len(members) <= 1 else len(members) * 18 / (2 * math.pi))
        for j, node in enumerate(members):
            r = got[node]
            assert (r.ring, r.degree, r["rank"]) == (ring, degree[node], start + j + 1)
            assert r.x == pytest.approx(radius * math.cos(2 * math.pi * j / len(members)), abs=1e-9)
            assert r.y == pytest.approx(radius * math.sin(2 * math.pi * j / len(members)), abs=1e-9)
        start, previous = end, radius


def test_reachability_is_closed(spark):
    """Unbounded depth reaches exactly the connected part."""
    rows = [("CALLS", i, i + 1) for i in range(6)]
    found = traverse.bfs(edges(spark, rows), spark.createDataFrame([(0,)], "seed long"), depth=20, max_nodes=None)
    queue, seen = deque([0]), {0}
    while queue:
        a = queue.popleft()
        for _, s, d in rows:
            if s == a and d not in seen:
                seen.add(d)
                queue.append(d)
    assert {r.id for r in found.collect()} == seen - {0}


def test_shuffle_partitions_follow_the_input_and_the_session(spark, tmp_path):
    key, advisory = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    with open(tmp_path / "big.parquet", "wb") as f:
        f.truncate(100 * INPUT_PER_PARTITION)
    own = spark.conf.get(advisory, None)
    try:
        fit_tasks(spark, str(tmp_path))
        assert spark.conf.get(key) == "100"
        fit_tasks(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set(key, "7")
        spark.conf.set(advisory, "1m")
        fit_tasks(spark, str(tmp_path))
        assert spark.conf.get(key) == "7" and spark.conf.get(advisory) == "1m"
    finally:
        spark.conf.unset(key)
        spark.conf.unset(advisory) if own is None else spark.conf.set(advisory, own)


def test_an_adjacency_drops_repeated_steps(spark):
    rows = [(repo, kind, 1, n) for n in (5, 3, 4) for repo in (1, 2) for kind in ("CALLS", "REFERENCES")] + [(1, "CALLS", 2, 7)]
    edges = spark.createDataFrame(rows, EDGE)
    assert sorted((r.id, r.nexts) for r in traverse.adjacency(edges, "out", max_nodes=1).collect()) == [(1, [3, 4]), (2, [7])]


@pytest.mark.parametrize("name, kinds", [("callees", {"CALLS"}), ("bfs_in", {"CALLS", "REFERENCES"})])
def test_traversals_store_only_edges_they_follow(spark, monkeypatch, name, kinds):
    stored = []
    monkeypatch.setattr(graph_queries, "materialize", lambda df, _: stored.append(df) or df)
    registry.PLANS[name](registry.Tables(spark, "/root/testdata/sf0.001"))
    assert {r.kind for r in stored[0].select("kind").distinct().collect()} == kinds


def test_lists_send_their_heads_and_the_rest_only_below_the_bound(spark, monkeypatch, tmp_path):
    """Two seeds with the same number of neighbours: the lists of one are alike, for the other all small ids are in one list."""
    monkeypatch.setattr(traverse, "scratch_root", lambda _: str(tmp_path))
    sent, gathered = [], traverse._gathered
    monkeypatch.setattr(traverse, "_gathered", lambda parts, *more: sent.append(parts) or gathered(parts, *more))
    alike = [(1, 100 + i) for i in range(20)] + [(100 + i, 1000 + 20 * j + i) for i in range(20) for j in range(30)]
    uneven = [(2, 200 + i) for i in range(20)] + [(200, 300 + j) for j in range(30)] + [(200 + i, 5000 + 30 * i + j) for i in range(1, 20) for j in range(30)]
    # of 600 ids in lists of 30, heads of 7; the uneven seed's bound lies in its fifth list, so that four lists send 23 more
    for rows, seed, rest in ((alike, 1, 0), (uneven, 2, 4 * 23)):
        sent.clear()
        graph = traverse.adjacency(edges(spark, [("CALLS", a, b) for a, b in rows]), "out", max_nodes=50)
        found = traverse.bfs(None, spark.createDataFrame([(seed,)], "seed long"), depth=2, max_nodes=50, graph=graph).collect()
        assert {(r.depth, r.id) for r in found} == brute_bfs(rows, seed, 2, 50)
        ids = [sum(len(r.part) for r in parts.collect()) for parts in sent]
        assert ids[0] == 20 and ids[1] == 20 * 7 and sum(ids[2:]) == rest


def test_a_stored_step_leaves_no_shuffle_files_and_an_adjacency_no_other_table(spark):
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    scratch = scratch_root(spark).removeprefix("file:")

    def shuffles():
        return {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_") and f.endswith(".data")}

    before, stored = shuffles(), set(os.listdir(scratch))
    rows = spark.range(2000).selectExpr("1L AS repo_id", "'CALLS' AS kind", "id % 50 AS src", "id AS dst").repartition(4)
    materialize(rows.groupBy("src").count(), "counts")
    assert not shuffles() - before
    traverse.adjacency(rows, "out", max_nodes=5)
    assert sorted(f.split("-")[0].split("_")[0] for f in set(os.listdir(scratch)) - stored) == ["adjacency", "counts"]
