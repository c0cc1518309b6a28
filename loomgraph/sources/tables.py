"""Durable tables: Parquet folders partitioned by repository.

Derived calls are pairs, n * m of n callers and m callees of a name, and would fill
the disk as rows.  They are stored as their ends (``call_ends``) and paired where the
edges are read; a CALLS row of the edge table itself stands before the derived one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import schemas
from loomgraph.operators import rules
from loomgraph.operators.edges import KEY
from loomgraph.session import materialize

TABLES = {
    "files": schemas.FILES,
    "symbols": schemas.SYMBOLS,
    "symbol_rows": schemas.SYMBOL_ROWS,
    "edges": schemas.EDGES,
    "call_ends": schemas.CALL_ENDS,
    "callsites": schemas.CALLSITES,
    "refs": schemas.REFS,
}
#: ``files`` comes last: it decides what a repeated run considers unchanged.
WRITE_ORDER = ("symbol_rows", "symbols", "callsites", "refs", "edges", "call_ends", "files")
#: A column that every real row fills.  Rows without it only mark a repository
#: as written, so that a table that became empty replaces its old partition.
FILLED = {"files": "path", "symbols": "kind", "symbol_rows": "kind", "edges": "kind", "call_ends": "id", "callsites": "callee_text", "refs": "ref_text"}


def create_tables(spark: SparkSession, base: str) -> None:
    """Write empty tables where there are none yet."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("repo_id").parquet(f"{base}/{name}")


def read_table(spark: SparkSession, base: str, name: str, repo_ids: Sequence[int] | None = None) -> DataFrame:
    """One table; a repository filter prunes the partitions that are read."""
    return read_edges(spark, base, repo_ids) if name == "edges" else read_stored(spark, base, name, repo_ids)


def read_edges(spark: SparkSession, base: str, repo_ids: Sequence[int] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """All edges, derived calls paired.

    ``labels`` (id, ...) are columns of the symbols to come along, as src_... and dst_...; they meet
    the ends before these are paired, so that no pair is shuffled.  Edges of symbols without labels are left out.
    """
    rows = read_stored(spark, base, "edges", repo_ids)
    own = rows.where("kind = 'CALLS'").select(*KEY)
    if not _is_there(spark, f"{base}/call_ends"):  # written before calls were stored by their ends
        ends = spark.createDataFrame([], schemas.CALL_ENDS)
    else:
        ends = read_stored(spark, base, "call_ends", repo_ids)
    if labels is not None:
        ends = materialize(ends.join(labels, "id"), "labelled-ends")
        for end in ("src", "dst"):
            rows = rows.join(labels.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in labels.columns if c != "id"]), end)
    calls = rules.paired_calls(ends)
    if not own.isEmpty():
        calls = calls.join(own, list(KEY), "left_anti")
    return rows.select(*calls.columns).unionByName(calls)


def _is_there(spark: SparkSession, folder: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def read_stored(spark: SparkSession, base: str, name: str, repo_ids: Sequence[int] | None = None) -> DataFrame:
    """One table as it is stored: edges without the calls that stand in ``call_ends``."""
    schema: T.StructType = TABLES[name]
    table = spark.read.schema(schema).parquet(f"{base}/{name}")
    if repo_ids is not None:
        table = table.where(F.col("repo_id").isin(*repo_ids))
    return table.where(F.col(FILLED[name]).isNotNull()).select(*schema.names)


def read_tables(spark: SparkSession, base: str, repo_ids: Sequence[int] | None = None) -> dict[str, DataFrame]:
    """All tables as they are stored, see ``read_stored``."""
    return {name: read_stored(spark, base, name, repo_ids) for name in TABLES}


def write_tables(tables: dict[str, DataFrame], repos: DataFrame, base: str) -> None:
    """Replace the given repositories (repo_id) by the new rows; others are not touched.

    Rows are stored in the scratch folder first, because they may come from the
    very partitions that are replaced.  Edges without ``call_ends`` are all edges.
    """
    if "edges" in tables and "call_ends" not in tables:
        tables = {**tables, "call_ends": repos.sparkSession.createDataFrame([], schemas.CALL_ENDS)}
    stored = {name: materialize(tables[name], f"next-{name}") for name in WRITE_ORDER if name in tables}
    for name, rows in stored.items():
        marks = repos.select("repo_id").distinct().select(*[
            F.col("repo_id") if f.name == "repo_id" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in TABLES[name]
        ])
        (
            rows.unionByName(marks)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("repo_id")
            .parquet(f"{base}/{name}")
        )
