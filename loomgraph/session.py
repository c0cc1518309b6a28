"""Shared-folder scratch tables and session defaults."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings the operators rely on.  All of them are ordinary SQL confs,
#: so they can be applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ranks up to this are cut in every map task, before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}

#: Bounds of what one task reads; they hold where the session has no values of its own.
TASK_CONF = {
    # a hash table or sort of ids takes many times the bytes of its shuffled or stored rows
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}
#: Input bytes per shuffle partition before small ones are merged.
INPUT_PER_PARTITION = 4 << 20
MOST_PARTITIONS = 4000
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_OURS = "loomgraph.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def fit_tasks(spark: SparkSession, folder: str) -> None:
    """Bound what one task reads, and ask for as many shuffle partitions as the files of a folder need, no fewer than the session's.

    So that the rows of one task do not grow with the input; adaptive execution
    merges partitions that turn out small.  Values the session has of its own stay.
    """
    for key, value in TASK_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    current = spark.conf.get(_PARTITIONS, None)
    if current is not None and current != spark.conf.get(_OURS, None):
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(place).getLength()
    wanted = min(size // INPUT_PER_PARTITION, MOST_PARTITIONS)
    number = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted))
    spark.conf.set(_PARTITIONS, number)
    spark.conf.set(_OURS, number)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, because a driver-local folder is not
    visible to the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner real
    file sizes, so that later joins broadcast the table only if it is small.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for written in getattr(_scopes, "open", [])[-1:]:
        written.append(path)
    with shuffles_removed(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether Spark removes the shuffle files of a query when it ends, and not when the driver's memory happens to be collected.
SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind, so that a job of many steps holds those of one step at a time.

    Only for writes: a frame that is collected twice would make its shuffles anew.
    """
    before = spark.conf.get(SHUFFLES_REMOVED, None)
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_REMOVED)
        else:
            spark.conf.set(SHUFFLES_REMOVED, before)


#: The tables written by ``materialize`` in each open ``scratch_scope`` of this thread.
_scopes = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``materialize`` writes inside, in this thread, when the block ends.

    For operations whose results are stored elsewhere by then, such as a
    micro-batch; frames read from such a table can't be used after the block.
    """
    stack = _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        _scopes.open = stack[:-1]
        for path in stack[-1]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
