"""Derived calls stored by their ends, and the join that pairs them."""

import os

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from loomgraph import schemas
from loomgraph.operators import rules, skew
from loomgraph.sources import files as fs
from loomgraph.sources import tables
from loomgraph.streaming import indexing
from tests.test_files import graph_of, toy_extractor, write

GO = {"go": toy_extractor}


def calls_of(spark, base):
    return sorted((r.s, r.d) for r in tables.read_table(spark, base, "edges").where("kind = 'CALLS'")
                  .join(tables.read_table(spark, base, "symbols").selectExpr("id AS src", "fqn AS s"), "src")
                  .join(tables.read_table(spark, base, "symbols").selectExpr("id AS dst", "fqn AS d"), "dst").collect())


def test_calls_are_stored_as_ends_and_read_as_pairs(spark, tmp_path):
    root, base = str(tmp_path / "src"), str(tmp_path / "kg")
    for i in range(30):
        write(root, f"p{i}/f.go", "def same: x.same\n")
    indexing.index_once(spark, base, fs.scan_files(spark, root), GO)
    every = sorted((f"p{a}.same", f"p{b}.same") for a in range(30) for b in range(30))
    assert calls_of(spark, base) == every
    stored = tables.read_stored(spark, base, "edges")
    assert stored.where("kind = 'CALLS'").isEmpty() and stored.count() == 30  # p DECLARES p.same
    assert tables.read_stored(spark, base, "call_ends").count() == 60
    labels = tables.read_table(spark, base, "symbols").select("id", "fqn")
    named = tables.read_edges(spark, base, labels=labels)
    assert sorted((r.src_fqn, r.dst_fqn) for r in named.where("kind = 'CALLS'").collect()) == every
    assert {(r.kind, r.src_fqn, r.dst_fqn) for r in named.collect()} == graph_of(spark, base)[0]
    os.remove(os.path.join(root, "p0/f.go"))
    write(root, "p1/f.go", "def other: same\n")
    indexing.index_once(spark, base, fs.scan_files(spark, root), GO)
    left = {f"p{a}.same" for a in range(2, 30)}
    assert calls_of(spark, base) == sorted((a, b) for a in left | {"p1.other"} for b in left)


def test_a_written_call_stands_before_the_derived_one(spark, tmp_path):
    root, base = str(tmp_path / "src"), str(tmp_path / "kg")
    write(root, "a/x.go", "def one: two\ndef three: two\n")
    write(root, "a/y.go", "def two: one\n")
    indexing.index_once(spark, base, fs.scan_files(spark, root), GO)
    calls, symbols = calls_of(spark, base), tables.read_table(spark, base, "symbols")
    assert calls == [("a.one", "a.two"), ("a.three", "a.two"), ("a.two", "a.one")]
    one = symbols.where("fqn = 'a.one'").first().id
    # as a semantic upgrade writes it: all edges are rows from now on
    edges = tables.read_table(spark, base, "edges").withColumn("provenance", F.when(F.col("src") == one, "server").otherwise(F.col("provenance")))
    edges = edges.withColumn("confidence", F.when(F.col("src") == one, 1.0).otherwise(F.col("confidence")))
    repos = symbols.select("repo_id").distinct()
    tables.write_tables({"edges": edges}, repos, base)
    assert tables.read_stored(spark, base, "call_ends").isEmpty() and calls_of(spark, base) == calls

    def upgraded():
        return [(r.src, r.confidence, r.provenance) for r in tables.read_table(spark, base, "edges").where("kind = 'CALLS' AND confidence = 1").collect()]

    assert upgraded() == [(one, 1.0, "server")]
    write(root, "a/z.go", "def four: two\n")
    indexing.index_once(spark, base, fs.scan_files(spark, root), GO)
    assert calls_of(spark, base) == sorted([*calls, ("a.four", "a.two")]) and upgraded() == [(one, 1.0, "server")]


def test_user_rules_make_rows_of_all_calls(spark, tmp_path):
    root, base = str(tmp_path / "src"), str(tmp_path / "kg")
    write(root, "a/x.go", "def one: two\ndef two: one\n")
    own = spark.createDataFrame([], schemas.EDGES)
    rules.register_rule("none", lambda symbols, callsites, refs: own)
    try:
        indexing.index_once(spark, base, fs.scan_files(spark, root), GO)
        assert tables.read_stored(spark, base, "call_ends").isEmpty()
        assert calls_of(spark, base) == [("a.one", "a.two"), ("a.two", "a.one")]
    finally:
        rules.unregister_rule("none")
    write(root, "a/y.go", "def three: one\n")
    indexing.index_once(spark, base, fs.scan_files(spark, root), GO)
    assert calls_of(spark, base) == [("a.one", "a.two"), ("a.three", "a.one"), ("a.two", "a.one")]


def test_pairs_are_dealt_in_cells_of_both_sides(spark, monkeypatch):
    """A key of 400 x 400 and lopsided ones in cells of 100 pairs give the pairs of a plain join; a row is repeated 40 times, not 400."""
    left = [("big", i) for i in range(400)] + [("tall", i) for i in range(500)] + [("wide", 0), ("alone", 1), (None, 2), ("one", 3)]
    right = [("big", i) for i in range(400)] + [("tall", 7)] + [("wide", i) for i in range(500)] + [("one", 4), (None, 5)]
    a, b = spark.createDataFrame(left, "k string, src long"), spark.createDataFrame(right, "k string, dst long")
    sides, repartition = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, *by: sides.append(df) or repartition(df, *by))
    pairs = skew.spread_pairs(a, b, ["k"], ["src"], task_pairs=100)
    want = sorted((k, x, y) for k, x in left for j, y in right if k is not None and k == j)
    assert sorted(tuple(r) for r in pairs.collect()) == want
    assert [side.where("k = 'big'").count() for side in sides] == [400 * 40, 400 * 40]
    sizes = pairs.where("k = 'big'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 160_000 / 50
