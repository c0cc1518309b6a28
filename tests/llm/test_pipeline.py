"""The pipeline against its stages done one by one with plain Python, and the SQL of the registered queries."""

import os

import pytest

import corpus_pipeline
from loomgraph.llm import line_dedup, packing, queries, templates
from tests.llm.test_search_and_dedup import brute_lines, brute_print

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns
    known = sorted((r.doc_id, r.text) for r in kept[1].select("doc_id", "text").collect())
    assert all(any(c.isalpha() for c in t) for _, t in known)
    lines = {i: t for i, (t, n) in brute_lines(known, line_dedup.WORDS).items() if t.strip() or not n}
    assert {r.doc_id: r.text for r in kept[2].collect()} == lines
    prints = {i: brute_print(t) for i, t in lines.items()}
    root, changed = {i: i for i in prints}, True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if root[b] < root[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a], changed = root[b], True
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted(set(root.values()))
    bad = {r.doc_id for r in templates.matches(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in kept[3].collect()} - bad
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept[4].collect()}
    want = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pieces(kept[4]).collect()}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in packed} == want


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_document(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.startswith("op7"):
        assert 0 < rows.count() < documents
    else:
        assert rows.select("doc_id").distinct().count() == documents
