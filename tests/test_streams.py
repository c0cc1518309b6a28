"""The request loop over a note table."""

import os
from datetime import timedelta

from loomgraph.operators import knowledge as kn
from loomgraph.plans.registry import Tables
from loomgraph.plans.stream_queries import _table_stream
from loomgraph.session import scratch_root
from loomgraph.streaming import notes
from tests.test_notes import LONG, T0, empty, store_rows

UPDATE = (None, False, None)


def test_stream_equals_batch_and_repeats_safely(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "store")
    rows = [(f"Note title {i % 7}", f"{LONG}{i % 11}", [], "global") for i in range(30)]
    stores = store_rows(spark, rows)
    shaped = stores.selectExpr("'store' AS op", "req_id", "ts", "NULL AS id", "title", "content", "tags", "false AS tags_provided", "scope")
    for part in range(3):
        chunk = shaped.where(f"req_id >= 'r{part * 10:03}' AND req_id < 'r{part * 10 + 10:03}'")
        spark.createDataFrame(chunk.coalesce(1).collect(), notes.REQUEST).coalesce(1).write.mode("append").parquet(source)
    late = [
        ("update", "u1", T0 + timedelta(hours=1), "r000", "Note title fresh", None, *UPDATE),
        ("update", "u2", T0 + timedelta(hours=2), "r001", "Note title fresh", None, *UPDATE),
        ("update", "u3", T0 + timedelta(hours=3), "gone", "Note title fresh", None, *UPDATE),
    ]
    spark.createDataFrame(late, notes.REQUEST).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(notes.REQUEST).option("maxFilesPerTrigger", 1).parquet(source)
    notes.start(stream, base, str(tmp_path / "ckpt"), available_now=True).awaitTermination()

    outcome, added = kn.store_batch(empty(spark), stores)
    want = {r.id: r.title for r in added.collect()} | {"r000": "Note title fresh"}
    assert {r.id: r.title for r in notes.current_notes(spark, base).collect()} == want
    codes = {r.req_id: (r.code, r.field) for r in notes.read_outcomes(spark, base).collect()}
    assert codes == {r.req_id: (r.code, r.field) for r in outcome.collect()} | {
        "u1": ("OK", None), "u2": ("DUPLICATE_KNOWLEDGE", "title"), "u3": ("NOT_FOUND", None),
    }
    # A repeated batch replaces its first attempt, and leaves no scratch tables.
    before = set(os.listdir(scratch_root(spark).removeprefix("file:")))
    notes.apply_requests(base)(shaped.where("req_id < 'r010'").selectExpr(*notes.REQUEST.names), 0)
    assert {r.id: r.title for r in notes.current_notes(spark, base).collect()} == want



def test_a_batch_reads_the_holders_of_its_keys(spark, tmp_path):
    """Renames, moves and swaps against a store of many notes: as one batch over the whole store, which is not read."""
    base = str(tmp_path / "store")
    notes.create_store(spark, base)
    rows = [(f"Note title {i}", f"{LONG}{i}", [], "global" if i % 2 else "repo:a") for i in range(60)]
    first = store_rows(spark, rows).selectExpr("'store' AS op", "req_id", "ts", "NULL AS id", "title", "content", "tags", "false AS tags_provided", "scope")
    notes.apply_requests(base)(first.selectExpr(*notes.REQUEST.names), 0)
    patches = [
        ("update", "u1", T0 + timedelta(days=1), "r001", "Note title 3", None, *UPDATE),  # taken
        ("update", "u2", T0 + timedelta(days=2), "r003", "Note title moved", None, *UPDATE),
        ("update", "u3", T0 + timedelta(days=3), "r001", "Note title 3", None, *UPDATE),  # free by now
        ("update", "u4", T0 + timedelta(days=4), "r002", None, None, None, False, "global"),
        ("update", "u5", T0 + timedelta(days=5), "r005", None, f"{LONG}2", *UPDATE),  # the content has moved to this scope
        ("store", "n1", T0 + timedelta(days=6), None, "NOTE title 7", f"{LONG}900", [], False, "global"),  # taken
        ("store", "n2", T0 + timedelta(days=7), None, "NOTE title 7", f"{LONG}901", [], False, "repo:a"),
    ]
    batch = spark.createDataFrame(patches, notes.REQUEST)
    stores = batch.where("op = 'store'").select(*[f.name for f in notes.schemas.STORE_REQUEST])
    near = notes.holders(spark, base, 1, notes.note_keys(kn.as_notes(stores)))
    assert [r.id for r in near.collect()] == ["r007"]
    before = notes.current_notes(spark, base)
    outcome, added = kn.store_batch(before, stores)
    after_outcome, after = kn.update_batch(
        before.unionByName(added.select(*before.columns)), batch.where("op = 'update'").select(*[f.name for f in notes.schemas.UPDATE_REQUEST])
    )
    want = {r.req_id: (r.code, r.field) for r in outcome.unionByName(after_outcome).collect()}
    table = sorted((r.id, r.title, r.content, r.scope) for r in after.collect())
    assert {c for c, _ in want.values()} == {"OK", "DUPLICATE_KNOWLEDGE"} and want["u3"][0] == "OK" and want["u5"][0] == "DUPLICATE_KNOWLEDGE"
    notes.apply_requests(base)(batch, 1)
    got = {r.req_id: (r.code, r.field) for r in notes.read_outcomes(spark, base).where("batch = 1").collect()}
    assert got == want
    assert sorted((r.id, r.title, r.content, r.scope) for r in notes.current_notes(spark, base).collect()) == table


def test_a_table_stream_reads_a_file_and_a_folder_of_part_files(spark, tmp_path):
    rows = spark.range(10).selectExpr("id AS page_id", "concat('<h1>', id, '</h1>') AS html")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "pages.parquet"))
    rows.toPandas().to_parquet(tmp_path / "pages.parquet")
    for folder in (tmp_path, tmp_path / "folder"):
        seen = []
        stream = _table_stream(Tables(spark, str(folder)), "pages").writeStream.foreachBatch(lambda b, _: seen.extend(r.page_id for r in b.collect()))  # noqa: B023
        stream.option("checkpointLocation", str(tmp_path / f"{folder.name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(seen) == list(range(10))
