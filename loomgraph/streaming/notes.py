"""Endless store / update request loop over a note table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomgraph import schemas
from loomgraph.functions.text import content_hash, normalize_scope, normalize_title
from loomgraph.operators.knowledge import COLUMNS, as_notes, store_batch, update_batch
from loomgraph.operators.textindex import word_filter
from loomgraph.session import materialize, scratch_scope

#: Requests of both kinds in one stream; ``op`` is store or update.
REQUEST = T.StructType([T.StructField("op", T.StringType()), *schemas.UPDATE_REQUEST.fields])
OUTCOME = "req_id string, code string, message string, existing_id string, field string, errors array<string>, batch long"
NOTES = T.StructType([*schemas.KNOWLEDGE.fields, T.StructField("batch", T.LongType())])
#: Title and content of every note version as hashes with their scope, sorted, so that a batch finds who holds its keys.
KEYS = "key string, id string, batch long"
NAMES = ("id", "scope", "normalized_title", "content_hash")


def create_store(spark: SparkSession, base: str) -> None:
    """Empty note, key and outcome tables."""
    spark.createDataFrame([], KEYS).write.mode("ignore").partitionBy("batch").parquet(f"{base}/keys")
    spark.createDataFrame([], NOTES).write.mode("ignore").partitionBy("batch").parquet(f"{base}/notes")
    spark.createDataFrame([], OUTCOME).write.mode("ignore").partitionBy("batch").parquet(f"{base}/outcomes")


def current_notes(
    spark: SparkSession, base: str, before: int | None = None, columns: Sequence[str] = COLUMNS,
    ids: DataFrame | None = None,
) -> DataFrame:
    """The notes as they were before a batch: the newest version of every id.

    Only the wanted columns are read; ``ids`` (a stored table) limits the rows, and
    of the files, sorted by id, only the row groups around them are read.
    """
    rows = spark.read.schema(NOTES).parquet(f"{base}/notes")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if ids is not None:
        rows = rows.where(word_filter(ids.select(F.col("id").alias("token")), "id")).join(ids.select("id").distinct(), "id", "left_semi")
    return (
        rows.groupBy("id")
        .agg(F.max_by(F.struct(*[c for c in columns if c != "id"]), "batch").alias("last"))
        .select("id", "last.*")
        .select(*columns)
    )


def read_outcomes(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(OUTCOME).parquet(f"{base}/outcomes")


def _key(kind: str, scope: str, value: str) -> Column:
    return F.hex(F.xxhash64(F.lit(kind), scope, value))


def note_keys(notes: DataFrame) -> DataFrame:
    """(key, id): the title and the content of each note inside its scope."""
    keys = F.array(_key("title", "scope", "normalized_title"), _key("content", "scope", "content_hash"))
    return notes.select(F.explode(keys).alias("key"), "id")


def claimed_keys(notes: DataFrame, patches: DataFrame) -> DataFrame:
    """(key): what the patched notes may claim on the way: any of their scopes with any of their titles and contents."""
    given = patches.select(
        "id", normalize_scope("scope").alias("to_scope"), F.col("scope").isNotNull().alias("moves"),
        F.when(F.col("title").isNotNull(), normalize_title("title")).alias("to_title"), F.when(F.col("content").isNotNull(), content_hash("content")).alias("to_content"),
    )
    told = given.groupBy("id").agg(
        F.collect_set(F.when(F.col("moves"), F.col("to_scope"))).alias("scopes"), F.collect_set("to_title").alias("titles"), F.collect_set("to_content").alias("contents")
    )
    every = notes.join(told, "id").select(
        F.explode(F.array_union(F.array("scope"), "scopes")).alias("scope"), F.array_union(F.array("normalized_title"), "titles").alias("titles"),
        F.array_union(F.array("content_hash"), "contents").alias("contents"),
    )
    return every.select("scope", F.explode("titles").alias("value")).select(_key("title", "scope", "value").alias("key")).unionByName(
        every.select("scope", F.explode("contents").alias("value")).select(_key("content", "scope", "value").alias("key"))
    )


def holders(spark: SparkSession, base: str, before: int, keys: DataFrame) -> DataFrame:
    """The current (NAMES) of notes that hold, or once held, one of the keys; row groups around the keys are read."""
    wanted = materialize(keys.select("key").distinct(), "wanted-keys")
    rows = spark.read.schema(KEYS).parquet(f"{base}/keys").where((F.col("batch") < before) & word_filter(wanted.withColumnRenamed("key", "token"), "key"))
    ids = materialize(rows.join(wanted, "key", "left_semi").select("id").distinct(), "key-holders")
    return materialize(current_notes(spark, base, before, NAMES, ids), "near-notes")


def apply_requests(base: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch function: stores first, then updates, each in (ts, req_id) order.

    A batch writes only its own partition and reads only earlier ones, so a
    repeated batch replaces its first attempt.  It looks up the notes it names and
    those that hold a key it claims; the rest of the store is not read.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        requests = materialize(batch, "requests")
        stores = requests.where("op = 'store'").select(*schemas.STORE_REQUEST.names)
        updates = requests.where("op = 'update'").select(*schemas.UPDATE_REQUEST.names)
        outcome, fresh = store_batch(holders(spark, base, batch_id, note_keys(as_notes(stores))), stores)
        if not updates.isEmpty():
            named = materialize(updates.where("id IS NOT NULL").select("id").distinct(), "patched-ids")
            touched = materialize(current_notes(spark, base, batch_id, ids=named).unionByName(fresh.select(*COLUMNS)), "touched-notes")
            # Other notes only matter by their keys; their texts stay unread.
            near = holders(spark, base, batch_id, claimed_keys(touched, updates))
            others = near.join(touched.select("id"), "id", "left_anti")
            blank = [
                (F.col(f.name) if f.name in NAMES else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schemas.KNOWLEDGE
            ]
            update_outcome, after = update_batch(touched.unionByName(others.select(*blank)), updates)
            outcome = outcome.unionByName(update_outcome)
            changed = after.join(named, "id", "left_semi").select(*COLUMNS)
            fresh = fresh.join(changed.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(changed)
        fresh = materialize(fresh.select(*COLUMNS), "new-versions")
        by_id = fresh.repartitionByRange("id").sortWithinPartitions("id")
        by_key = note_keys(fresh).repartitionByRange("key").sortWithinPartitions("key")
        for rows, name in ((outcome, "outcomes"), (by_id, "notes"), (by_key, "keys")):
            rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")

    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            apply(batch, batch_id)

    return run


def start(requests: DataFrame, base: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run the loop on a stream of REQUEST rows."""
    create_store(requests.sparkSession, base)
    writer = requests.writeStream.foreachBatch(apply_requests(base)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
