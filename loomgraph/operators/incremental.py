"""Incremental maintenance of the file, symbol, call-site and ref tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.edges import cascade, set_null_missing

FILE_KEY = ["repo_id", "path"]


def stable_id(*key: Column | str) -> Column:
    """Surrogate key derived from the natural key, the same in every run."""
    return F.xxhash64(*key)


def file_id() -> Column:
    return stable_id(F.lit("file"), "repo_id", "path")


def symbol_id() -> Column:
    """Id of a symbol: by (repo, kind, fqn), or by its place if it has no FQN."""
    return F.when(F.col("fqn").isNotNull(), stable_id(F.lit("symbol"), "repo_id", "kind", "fqn")).otherwise(
        stable_id(F.lit("symbol-at"), "repo_id", "file_id", "kind", "name", "start_byte", "end_byte")
    )


def id_collisions(rows: DataFrame, key: Sequence[str], id_col: str = "id") -> DataFrame:
    """Ids shared by different natural keys; must be empty."""
    return (
        rows.select(id_col, *key).distinct().groupBy(id_col).agg(F.count(F.lit(1)).alias("keys")).where("keys > 1")
    )


def change_status(prior: DataFrame, current: DataFrame, full: bool = False) -> DataFrame:
    """Current files with status new, changed or unchanged.

    A file is unchanged only if its stored mtime and hash both agree; ``full``
    treats every file as not seen before.
    """
    known = prior.select(*FILE_KEY, F.col("sha256").alias("__sha"), F.col("mtime").alias("__mtime"),
                         F.lit(True).alias("__known"))
    same = F.col("mtime").eqNullSafe(F.col("__mtime")) & F.col("sha256").eqNullSafe(F.col("__sha"))
    status = (
        F.when(F.lit(full) | F.col("__known").isNull(), "new")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return current.join(known, FILE_KEY, "left").withColumn("status", status).drop("__sha", "__mtime", "__known")


def stale_files(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files that the scan no longer finds."""
    return prior.join(current.select(*FILE_KEY), FILE_KEY, "left_anti")


def upsert_files(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update by (repo, path); a stored file keeps its id and language."""
    keep_old = {"id", "lang"}
    old = prior.select(*FILE_KEY, *[F.col(c).alias(f"old_{c}") for c in prior.columns if c not in FILE_KEY])
    new = incoming.select(*FILE_KEY, *[F.col(c).alias(f"new_{c}") for c in prior.columns if c not in FILE_KEY],
                          F.lit(True).alias("__new"))
    joined = old.join(new, FILE_KEY, "full_outer")

    def value(c: str) -> Column:
        if c in keep_old:
            return F.coalesce(f"old_{c}", f"new_{c}").alias(c)
        return F.when(F.col("__new"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)

    return joined.select(*[F.col(c) if c in FILE_KEY else value(c) for c in prior.columns])


def upsert_repos(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update by root path; ``created_at`` and the id of a stored repo stay."""
    old = prior.select("root_path", *[F.col(c).alias(f"old_{c}") for c in prior.columns if c != "root_path"])
    joined = old.join(incoming.withColumn("__new", F.lit(True)), "root_path", "full_outer")
    return joined.select(
        F.coalesce("old_id", "id").alias("id"),
        "root_path",
        F.when(F.col("__new"), F.col("name")).otherwise(F.col("old_name")).alias("name"),
        F.coalesce("old_created_at", "created_at").alias("created_at"),
        F.when(F.col("__new"), F.col("updated_at")).otherwise(F.col("old_updated_at")).alias("updated_at"),
    )


def upsert_symbols(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """Insert or update by (repo, kind, fqn): the last writer's values win.

    ``incoming`` has the existing columns plus the ``order`` columns.  Id and
    language come from the first writer.  Symbols without an FQN never clash.
    """
    key = ["repo_id", "kind", "fqn"]
    first_kept = [c for c in ("id", "lang") if c in existing.columns]
    values = [c for c in existing.columns if c not in key and c not in first_kept]
    stamp = F.struct(F.lit(1).alias("new"), *order)
    blank = F.struct(F.lit(0).alias("new"), *[F.lit(None).cast(incoming.schema[c].dataType).alias(c) for c in order])
    both = existing.withColumn("__at", blank).unionByName(incoming.withColumn("__at", stamp).drop(*order))
    merged = (
        both.where("fqn IS NOT NULL")
        .groupBy(*key)
        .agg(
            F.max_by(F.struct(*values), "__at").alias("last"),
            F.min_by(F.struct(*first_kept), "__at").alias("first"),
        )
        .select(*key, *[F.col(f"first.{c}").alias(c) for c in first_kept], *[F.col(f"last.{c}").alias(c) for c in values])
    )
    return merged.select(*existing.columns).unionByName(both.where("fqn IS NULL").select(*existing.columns))


def replace_by_file(old: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """Drop the rows of the touched files, then add the new rows."""
    return old.join(touched.select("file_id").distinct(), "file_id", "left_anti").select(*old.columns).unionByName(
        new.select(*old.columns)
    )


def delete_files(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Remove files with everything that hangs on them.

    ``tables`` holds files, symbols, edges, callsites and refs; ``removed`` has
    the file ids.  Symbols, call sites and refs of a file go with it, edges go
    with either end, and references to a vanished symbol become NULL.
    """
    gone = removed.select(F.col("id").alias("file_id")).distinct()
    symbols = tables["symbols"].join(gone, "file_id", "left_anti").select(*tables["symbols"].columns)
    callsites = tables["callsites"].join(gone, "file_id", "left_anti").select(*tables["callsites"].columns)
    refs = tables["refs"].join(gone, "file_id", "left_anti").select(*tables["refs"].columns)
    return {
        "files": tables["files"].join(removed.select("id").distinct(), "id", "left_anti").select(*tables["files"].columns),
        "symbols": symbols,
        "edges": cascade(tables["edges"], symbols),
        "callsites": set_null_missing(callsites, ["caller", "resolved"], symbols),
        "refs": set_null_missing(refs, ["src", "dst"], symbols),
    }


def clear_repo(tables: dict[str, DataFrame], repo_id: int) -> dict[str, DataFrame]:
    """Drop everything indexed for one repository."""
    return {name: table.where(F.col("repo_id") != repo_id) for name, table in tables.items()}


def run_summary(results: DataFrame) -> DataFrame:
    """Counts of one run from per-file rows (status, n_symbols, n_callsites, error).

    A file with an error counts only as an error; an unchanged file only as
    unchanged.
    """
    failed = F.col("error").isNotNull()
    unchanged = F.col("status") == "unchanged"
    done = ~failed & ~unchanged
    return results.agg(
        F.count_if(done).alias("indexed"),
        F.count_if(unchanged).alias("unchanged"),
        F.coalesce(F.sum(F.when(done, F.col("n_symbols"))), F.lit(0)).cast("long").alias("symbols"),
        F.coalesce(F.sum(F.when(done, F.col("n_callsites"))), F.lit(0)).cast("long").alias("callsites"),
        F.count_if(failed & ~unchanged).alias("errors"),
    )


def mark_resolved(callsites: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Set ``resolved`` from (id, symbol_id) rows."""
    found = resolutions.select("id", F.col("symbol_id").alias("__symbol"))
    return (
        callsites.join(found, "id", "left")
        .withColumn("resolved", F.coalesce("__symbol", "resolved"))
        .select(*callsites.columns)
    )


def unresolved_callsites(callsites: DataFrame, limit: int = 1000) -> DataFrame:
    """Work list of call sites without a target, in id order."""
    return callsites.where("resolved IS NULL").orderBy("id").limit(limit if limit > 0 else 1000)
