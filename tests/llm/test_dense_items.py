"""Benchmark items of which no window holds enough plain words."""

from loomgraph.llm import templates

SUM = "What is 12 kg plus 30 kg minus 5 kg divided by 3 kg?"


def test_dense_items(spark):
    items = [(1, SUM), (2, "What is 17 times 23?"), (3, "7 8 9 10 11 12 13 14 15 16"), (4, "Add 5 and"), (5, "")]
    rows = [
        (1, f"Intro. {SUM} More."), (2, "Intro. What is 14 kg plus 31 kg minus 6 kg divided by 4 kg? More."), (3, "So. What is 17 times 23? Yes."),
        (4, "So. What is 18 times 23? Yes."), (5, "7 8 9 10 11 12 13 14 15 16"), (6, "7 8 9 10 11 12 13 14 15 17"), (7, "Add 5 and"), (8, None),
        (9, "What is 12 kg plus 30 kg and 3 kg? " + "8 kg " * 2000), (10, "word " * 3000 + SUM),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r for r in templates.matches(docs, bench, dense=True).collect()}
    assert set(got) == {(1, 1), (2, 1), (10, 1), (3, 2), (5, 3)}
    assert got[2, 1].slots_changed and not got[1, 1].slots_changed
    assert sorted(r.doc_id for r in templates.drop_contaminated(docs, bench).collect()) == [4, 6, 7, 8, 9]
    assert templates.matches(docs, bench).count() == 0
