"""User extension points: per-language extractors and row callbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loomgraph.operators.incremental import file_id, symbol_id
from loomgraph.schemas import FILE_EXTRACT

#: extract(content, path, repo_id) -> dict with any of the FILE_EXTRACT groups.
Extractor = Callable[[str, str, int], dict[str, Any]]
GROUPS = ("symbols", "callsites", "imports", "extends", "implements", "type_refs")


def extract_files(files: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """Run the extractor of each file's language over (repo_id, path, lang, content).

    A file whose extractor fails is kept with empty groups and its error text;
    files of other languages are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                found: dict[str, Any] = {}
                error = None
                try:
                    found = extractors[row.lang](row.content, row.path, row.repo_id)
                except Exception as problem:  # the contract: never fatal
                    error = f"{type(problem).__name__}: {problem}"
                rows.append(
                    {
                        "repo_id": row.repo_id, "path": row.path, "lang": row.lang,
                        "src_pkg_fqn": found.get("src_pkg_fqn"),
                        **{g: [_complete(g, x) for x in found.get(g, [])] for g in GROUPS},
                        "parse_error": error,
                    }
                )
            yield pd.DataFrame(rows, columns=FILE_EXTRACT.names)

    wanted = files.where(F.col("lang").isin(*extractors)).select("repo_id", "path", "lang", "content")
    return wanted.mapInPandas(run, FILE_EXTRACT)


_FIELDS = {
    field.name: field.dataType.elementType.names
    for field in FILE_EXTRACT
    if field.name in GROUPS and hasattr(field.dataType.elementType, "names")
}


def _complete(group: str, item: Any) -> Any:
    """A group item with every field of its struct; absent ones are None."""
    return {name: item.get(name) for name in _FIELDS[group]} if group in _FIELDS else item


def extracted_symbols(extracts: DataFrame) -> DataFrame:
    """Symbols of extracted files as table rows with stable ids."""
    rows = extracts.select("repo_id", "path", "lang", F.posexplode("symbols").alias("seq", "s")).select(
        "repo_id", "path", "lang", "seq", "s.*"
    )
    return (
        rows.withColumn("fqn", F.nullif("fqn", F.lit("")))
        .withColumn("file_id", file_id())
        .withColumn("id", symbol_id())
    )


def extracted_callsites(extracts: DataFrame) -> DataFrame:
    """Call sites of extracted files as table rows; caller and target still unknown."""
    rows = extracts.select("repo_id", "path", F.posexplode("callsites").alias("seq", "c")).select(
        "repo_id", "path", "seq", "c.*"
    )
    unknown = F.lit(None).cast("long")
    return (
        rows.withColumn("file_id", file_id())
        .withColumn("id", F.xxhash64(F.lit("callsite"), "repo_id", "path", "seq"))
        .withColumn("caller", unknown)
        .withColumn("resolved", unknown)
    )


def extracted_refs(extracts: DataFrame, group: str) -> DataFrame:
    """One ref group as (repo_id, file_id, src_fqn, ref_text), ready for the bind functions."""
    if group == "imports":
        rows = extracts.select("repo_id", "path", F.col("src_pkg_fqn").alias("src_fqn"), F.explode("imports").alias("ref_text"))
    else:
        rows = extracts.select("repo_id", "path", F.explode(group).alias("r")).select(
            "repo_id", "path", "r.src_fqn", "r.ref_text"
        )
    return rows.select("repo_id", file_id().alias("file_id"), "src_fqn", "ref_text").distinct()


def for_each_row(rows: DataFrame, callback: Callable[[Row], None]) -> None:
    """Call back for every row, inside the tasks that hold the rows."""

    def run(partition: Iterator[Row]) -> None:
        for row in partition:
            callback(row)

    rows.foreachPartition(run)
