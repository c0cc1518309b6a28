"""Repeated incremental indexing: changed files in, up-to-date graph tables out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomgraph import schemas
from loomgraph.operators import differential, extract
from loomgraph.operators import incremental as inc
from loomgraph.operators import rules
from loomgraph.operators.edges import add_missing
from loomgraph.operators.plugin import (
    Extractor,
    extract_files,
    extracted_callsites,
    extracted_refs,
    extracted_symbols,
)
from loomgraph.operators.spans import attribute_callers
from loomgraph.session import materialize, scratch_scope
from loomgraph.sources.files import scan_sources, sha256_hex, with_lang
from loomgraph.sources.tables import create_tables, read_stored, read_tables, write_tables


#: Repositories that are named in a partition filter; more are selected by a join.
PRUNED_REPOS = 1000


def _shape(rows: DataFrame, schema: Iterable[T.StructField]) -> DataFrame:
    """Rows in table shape; columns the source lacks are NULL."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def _extracts(work: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """The files taken apart by the extractors, and by the built-in one where HTML or CSS has none."""
    found = extract_files(work, extractors)
    own = [lang for lang in extract.MARKUP if lang not in extractors]
    langs = {r.lang for r in work.select("lang").distinct().collect()}  # of the handful that paths tell
    if not langs & set(own):
        return found
    return found.unionByName(extract.markup(work.where(F.col("lang").isin(*own))))


def _next_edges(before: dict[str, DataFrame], after: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """The stored edges after a change of the rows of ``files`` (file_id); see ``differential``.

    Derived calls are among them with user rules only, else they are stored by their ends.
    """
    old = before["edges"]
    is_semantic = (F.col("confidence") >= 1.0) & (F.col("provenance") != "extractor")
    derived = old.where(~is_semantic)
    if before["symbols"].isEmpty() or rules.has_user_rules():
        semantic = inc.cascade(old.where(is_semantic), after["symbols"])
        fresh = rules.build_edges(after["symbols"], after["callsites"], after["refs"], attribute=False, calls=rules.has_user_rules())
        return add_missing(semantic.select(*fresh.columns), fresh)
    if files.isEmpty():
        return old
    touched, fresh = differential.edge_changes(before, after, files, calls=False)
    kept = differential.untouched(derived, materialize(touched, "touched-ends"))
    dead = before["symbols"].select("id").join(after["symbols"].select("id"), "id", "left_anti")
    semantic = old.where(is_semantic)
    for end in ("src", "dst"):
        semantic = semantic.join(dead.withColumnRenamed("id", end), end, "left_anti").select(*old.columns)
    # a kept edge has no touched end, a fresh one has
    return add_missing(semantic.select(*fresh.columns), kept.select(*fresh.columns).unionByName(fresh))


def index_files(
    tables: dict[str, DataFrame],
    files: DataFrame,
    extractors: dict[str, Extractor],
    *,
    complete: bool = False,
    full: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """New tables and the run summary after indexing ``files`` (repo_id, path, mtime, size, content).

    Files that are known to be unchanged may come without content, with their sha256.

    ``complete`` says that the files are the whole repositories, so stored
    files missing from them are stale.  Unchanged files are not extracted.
    Edges are derived again where an end's symbol, calls or refs have changed,
    also those from unchanged files into changed ones; user rules are run as a
    whole.  Semantic edges whose two ends survive are kept.
    """
    prior, stored = tables["files"], tables
    seen = inc.change_status(
        prior,
        with_lang(files).withColumn("sha256", F.coalesce(sha256_hex("content"), "sha256") if "sha256" in files.columns else sha256_hex("content")),
        full,
    )
    # only changed files keep their text on the way
    kept = F.when(F.col("status") != "unchanged", F.col("content").cast("string"))
    seen = materialize(seen.withColumn("content", kept), "scan")
    raw = tables["symbol_rows"]
    if complete:
        # What hangs on the stale files goes by file; references into them are
        # checked below against the symbols that are left.
        stale = inc.stale_files(prior, seen)
        gone = stale.select(F.col("id").alias("file_id"))
        raw, callsites, refs = (
            rows.join(gone, "file_id", "left_anti").select(*rows.columns)
            for rows in (raw, tables["callsites"], tables["refs"])
        )
        files_left = prior.join(stale.select("id"), "id", "left_anti").select(*prior.columns)
        tables = {**tables, "files": files_left, "callsites": callsites, "refs": refs}
    work = seen.where("status <> 'unchanged'")
    extracts = materialize(_extracts(work, extractors), "extracts")
    touched = work.withColumn("id", inc.file_id()).withColumn("indexed_at", F.current_timestamp())
    known = tables["files"].select(*inc.FILE_KEY, F.col("id").alias("known_id"))
    touched = (
        touched.join(known, inc.FILE_KEY, "left").withColumn("id", F.coalesce("known_id", "id")).drop("known_id")
    )
    new_files = inc.upsert_files(tables["files"], _shape(touched, schemas.FILES))
    file_ids = materialize(touched.select(F.col("id").alias("file_id")), "touched-files")
    moved = file_ids if not complete else file_ids.unionByName(gone)

    # A symbol that several files mention survives as long as one of them does.
    raw = materialize(
        inc.replace_by_file(
            raw.select(*schemas.SYMBOL_ROWS.names), file_ids, _shape(extracted_symbols(extracts), schemas.SYMBOL_ROWS)
        ),
        "symbol-rows",
    )
    nothing = raw.select(*schemas.SYMBOLS.names).where("false")
    symbols = materialize(inc.upsert_symbols(nothing, raw, ["path", "seq"]), "symbols")
    callsites = inc.replace_by_file(
        tables["callsites"], file_ids, _shape(extracted_callsites(extracts), schemas.CALLSITES)
    )
    callsites = inc.set_null_missing(callsites, ["caller", "resolved"], symbols)
    callsites = materialize(attribute_callers(callsites, symbols), "callsites")
    bound = (
        rules.bind_imports(symbols, extracted_refs(extracts, "imports"))
        .unionByName(rules.bind_extends(symbols, extracted_refs(extracts, "extends")))
        .unionByName(rules.bind_implements(symbols, extracted_refs(extracts, "implements")))
        .unionByName(rules.bind_type_refs(symbols, extracted_refs(extracts, "type_refs")))
    )
    refs = inc.replace_by_file(tables["refs"], file_ids, _shape(bound, schemas.REFS))
    refs = materialize(inc.set_null_missing(refs, ["src", "dst"], symbols), "refs")
    edges = _next_edges(stored, {"symbols": symbols, "callsites": callsites, "refs": refs}, moved)
    ends = rules.call_ends(symbols, callsites)
    if rules.has_user_rules():  # which may make calls as well: all edges are rows
        ends = ends.where("false")
    results = seen.select("repo_id", "path", "status").join(
        extracts.groupBy("repo_id", "path").agg(F.sum(F.size("symbols")).alias("n_symbols"), F.sum(F.size("callsites")).alias("n_callsites")),
        ["repo_id", "path"], "left",
    ).withColumn("error", F.lit(None).cast("string"))
    return (
        {
            "files": new_files, "symbol_rows": raw, "symbols": symbols, "callsites": callsites, "refs": refs,
            "edges": _shape(edges, schemas.EDGES), "call_ends": _shape(ends, schemas.CALL_ENDS),
        },
        inc.run_summary(results),
    )


def index_once(
    spark: SparkSession, base: str, files: DataFrame, extractors: dict[str, Extractor],
    *, complete: bool = True, full: bool = False,
) -> DataFrame:
    """Index into the stored tables and return the run summary.

    Only the partitions of the repositories in ``files`` are replaced; up to
    PRUNED_REPOS of them are also the only ones that are listed and read.
    """
    with scratch_scope(spark):
        create_tables(spark, base)
        repos = materialize(files.select("repo_id").distinct(), "repos")
        ids = [r.repo_id for r in repos.limit(PRUNED_REPOS + 1).collect()]
        if len(ids) <= PRUNED_REPOS:
            tables = read_tables(spark, base, ids)
        else:
            tables = {
                name: table.join(repos, "repo_id", "left_semi").select(*table.columns)
                for name, table in read_tables(spark, base).items()
            }
        after, summary = index_files(tables, files, extractors, complete=complete, full=full)
        counts = summary.collect()  # one row
        write_tables(after, repos, base)
    return spark.createDataFrame(counts, summary.schema)


def start(
    files: DataFrame, base: str, checkpoint: str, extractors: dict[str, Extractor], available_now: bool = False
) -> StreamingQuery:
    """Index every micro-batch of a file stream (see ``stream_files``)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            with scratch_scope(batch.sparkSession):
                index_once(batch.sparkSession, base, materialize(batch, "arrivals"), extractors, complete=False)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watch(
    spark: SparkSession, root: str, base: str, checkpoint: str, extractors: dict[str, Extractor], *,
    repo_id: int = 1, ignore_lines: Sequence[str] = (), langs: Sequence[str] = (), every: str = "1 minute", ticks: int | None = None,
) -> StreamingQuery:
    """Keep the tables in step with a folder: every tick lists it and indexes what is new, changed or gone.

    All names are seen, and only files whose time or size differ from the stored
    ones are opened.  A tick is a micro-batch, so a restarted query goes on with the
    next one.  ``ticks`` ends the query after so many.
    """
    done = 0

    def run(batch: DataFrame, batch_id: int) -> None:
        nonlocal done
        if ticks is not None and done >= ticks:
            return
        create_tables(spark, base)
        known = read_stored(spark, base, "files", [repo_id])
        with scratch_scope(spark):
            index_once(spark, base, scan_sources(spark, root, repo_id, ignore_lines, langs, known), extractors, complete=True)
        done += 1
        if ticks is not None and done >= ticks:
            query.stop()

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = clock.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime=every).start()
    return query
