"""Source-file scan: listing, language, ignore rules, hashes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.paths import LANGS, classify_lang, relative_path, to_slash
from loomgraph.functions.text import col
from loomgraph.session import materialize

LISTED = "path string, is_dir boolean, mtime bigint, size bigint, error string"
#: Folders that one listing task takes at a time at least.
DIRS_PER_TASK = 64
#: Bytes of content that one Arrow batch holds at most, unless one file is longer.
CONTENT_BYTES = 16 << 20
HIDDEN = r"(^|/)(\.[^/]*|vendor)"


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder name (a local path or a URI) and the path in it."""
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def _entries(store: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """(name, is_dir, mtime, size) of a folder's files and folders; of links only those to files.

    An entry that can't be looked at, or is neither, is left out.
    """
    if not isinstance(store, pafs.LocalFileSystem):
        for info in store.get_file_info(pafs.FileSelector(folder)):
            if info.type in (pafs.FileType.Directory, pafs.FileType.File):
                is_dir = info.type == pafs.FileType.Directory
                yield info.base_name, is_dir, None if is_dir else int(info.mtime.timestamp()), None if is_dir else info.size
        return
    with os.scandir(folder) as found:
        for entry in found:
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, None, None
                elif entry.is_file():
                    stat = entry.stat()
                    yield entry.name, False, int(stat.st_mtime), stat.st_size
            except OSError:
                continue


def _list_dirs(root: str):
    """A task that lists folders (path, relative to ``root``); one that can't be listed is a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                above = f"{folder}/" if folder else ""
                try:
                    rows += [(above + name, *rest, None) for name, *rest in _entries(store, f"{base}/{folder}" if folder else base)]
                except OSError as problem:
                    rows.append((folder, None, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["path", "is_dir", "mtime", "size", "error"]).astype({"mtime": "Int64", "size": "Int64", "is_dir": "boolean"})

    return run


def rules_column(lines: Sequence[str]) -> Column:
    """The rules of one ignore file as a constant, as ``is_ignored`` takes them."""
    parsed = [(i, *rule) for i, rule in enumerate(map(ignore_rule, lines)) if rule]
    rules = [F.struct(F.lit(i).cast("long").alias("ord"), F.lit(negated).alias("negated"), F.lit(regex).alias("regex")) for i, negated, regex in parsed]
    return F.array(*rules) if rules else F.array().cast("array<struct<ord:bigint,negated:boolean,regex:string>>")


def list_tree(spark: SparkSession, root: str, ignore_lines: Sequence[str] = (), hidden: bool = True) -> tuple[DataFrame, DataFrame]:
    """((path, mtime, size) of all files below ``root``, (path, error) of the folders that can't be listed); no file is opened.

    Folders are a frontier of rows, one level of the tree per round, that tasks
    list side by side; every level is written to the shared folder.  What the
    ignore lines drop, and without ``hidden`` vendor folders and those that start
    with a dot, never joins the frontier, so nothing below it is listed.  Links to
    folders are not followed.
    """
    frontier = spark.createDataFrame([("",)], "path string")
    levels: list[DataFrame] = []
    n = 1
    while n:
        tasks = min(n // DIRS_PER_TASK + 1, 10_000)
        listed = frontier.repartition(tasks).mapInPandas(_list_dirs(root), LISTED)
        if ignore_lines:
            listed = listed.where(F.col("error").isNotNull() | ~is_ignored("path", rules_column(ignore_lines)))
        if not hidden:
            listed = listed.where(F.col("error").isNotNull() | ~F.col("is_dir") | ~F.col("path").rlike(HIDDEN + "$"))
        levels.append(materialize(listed, "listed"))
        frontier = levels[-1].where("is_dir").select("path")
        n = frontier.count()
    listed = reduce(DataFrame.unionByName, levels)
    return listed.where("NOT is_dir").select("path", "mtime", "size"), listed.where("error IS NOT NULL").select("path", "error")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: (path, mtime, size), whatever their names; folders that can't be listed are skipped."""
    return list_tree(spark, root)[0]


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """Add ``content`` to listed files; files that have vanished since or can't be read drop out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                try:
                    with store.open_input_stream(f"{base}/{row.path}") as stream:
                        content = stream.read()
                except OSError:
                    continue
                rows.append((*row, content))
                held += len(content)
                if held > CONTENT_BYTES:
                    yield pd.DataFrame(rows, columns=[*batch.columns, "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=[*batch.columns, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{schema}, content binary")


def scan_files(spark: SparkSession, root: str, repo_id: int = 1, content: bool = True) -> DataFrame:
    """All files below ``root``: (repo_id, path, mtime, size, content), names that start with ``_`` or ``.`` included.

    Without ``content`` no file is opened.  Filter the listing first where only
    some contents are wanted (``list_files``, then ``read_contents``).
    """
    files = list_files(spark, root)
    if content:
        files = read_contents(files, root)
    return files.select(F.lit(repo_id).cast("long").alias("repo_id"), *files.columns)


def scan_sources(
    spark: SparkSession, root: str, repo_id: int = 1, ignore_lines: Sequence[str] = (), langs: Sequence[str] = (), known: DataFrame | None = None,
) -> DataFrame:
    """The source files to index: (repo_id, path, mtime, size, content, lang, sha256).

    The same files as ``discover`` on a whole scan, but hidden and ignored folders
    are not listed, and only files of a wanted language are opened.  With ``known``
    (the stored files) those whose time and size are the stored ones are not opened
    either: they carry the stored sha256 and no content.
    """
    files, _ = list_tree(spark, root, ignore_lines, hidden=False)
    wanted = materialize(with_lang(files.select(F.lit(repo_id).cast("long").alias("repo_id"), "path", "mtime", "size"), langs), "sources")
    nothing = [F.lit(None).cast("binary").alias("content")]
    if known is None:
        return read_contents(wanted, root).withColumn("sha256", sha256_hex("content"))
    stored = known.select("repo_id", "path", "mtime", "size", F.col("sha256").alias("stored"))
    seen = wanted.join(stored, ["repo_id", "path", "mtime", "size"], "left").select(*wanted.columns, "stored")
    same = seen.where("stored IS NOT NULL").select(*wanted.columns, *nothing, F.col("stored").alias("sha256"))
    return read_contents(seen.where("stored IS NULL").drop("stored"), root).withColumn("sha256", sha256_hex("content")).unionByName(same)


#: What Spark's file stream gives.
SCAN_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, root: str, repo_id: int = 1, files_per_batch: int = 1000) -> DataFrame:
    """The rows of new files as an endless stream.

    Spark's file stream does not see names that start with ``_`` or ``.``;
    ``streaming.indexing.watch`` does, and changed and removed files too.
    """
    found = (
        spark.readStream.format("binaryFile")
        .schema(SCAN_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    place = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    plain_root = re.sub(r"^[a-z][a-z0-9+.-]*:(?://[^/]*)?(?=/)", "", root)
    return found.select(
        F.lit(repo_id).cast("long").alias("repo_id"),
        relative_path(place, F.lit(plain_root)).alias("path"),
        F.unix_seconds("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
        "content",
    )


def sha256_hex(content: Column | str) -> Column:
    return F.sha2(col(content), 256)


def parse_langs(text: str | None) -> list[str]:
    """Comma-separated language filter; empty means all."""
    return [part.strip().lower() for part in (text or "").split(",") if part.strip()]


def with_lang(files: DataFrame, langs: Sequence[str] = ()) -> DataFrame:
    """Add ``lang`` and keep source files of the wanted languages (all by default)."""
    wanted = [x.strip().lower() for x in langs if x.strip()] or list(LANGS)
    return files.withColumn("lang", classify_lang("path")).where(F.col("lang").isin(*wanted))


def drop_hidden(files: DataFrame) -> DataFrame:
    """Drop files below ``.git``, ``vendor`` or any directory that starts with a dot."""
    return files.where(~to_slash("path").rlike(HIDDEN + "/"))


def glob_to_regex(glob: str) -> str | None:
    """Regex of a shell glob (``*``, ``?``, ``[...]``, ``\\x``) inside one path component; None if malformed."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\":
            if i + 1 >= len(glob):
                return None
            i += 1
            out.append(re.escape(glob[i]))
        elif ch == "[":
            close = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "^" else i + 3)
            if close < 0:
                return None
            body = glob[i + 1 : close]
            sign = "^" if body.startswith("^") else ""
            body = body[1:] if sign else body
            safe = "".join("\\" + c if c in "[]^&\\" else c for c in body)
            out.append(f"[{sign}{safe}]" if not sign else f"[^/{safe}]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def ignore_rule(line: str) -> tuple[bool, str] | None:
    """(negated, regex on the whole path) of one ignore line; None if it matches nothing.

    A rule with a slash inside or in front is anchored to the root: it matches
    its glob, or anything below its literal text.  Other rules match any path
    component.
    """
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    pattern = text[1:] if negated else text
    anchored = pattern.startswith("/")
    clean = pattern.removeprefix("/").removesuffix("/")
    regex = glob_to_regex(clean)
    if anchored or "/" in clean:
        below = re.escape(clean) + "/.*"
        return negated, f"^(?:{below})$" if regex is None else f"^(?:{regex}|{below})$"
    if regex is None:
        return None
    return negated, f"^(?:.*/)?{regex}(?:/.*)?$"


def ignore_rules(lines: DataFrame) -> DataFrame:
    """Ignore lines (repo_id, ord, line) as one rule list per repository: (repo_id, rules)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                rule = ignore_rule(row.line)
                if rule:
                    rows.append((row.repo_id, row.ord, *rule))
            yield pd.DataFrame(rows, columns=["repo_id", "ord", "negated", "regex"])

    rules = lines.select("repo_id", "ord", "line").mapInPandas(
        parse, "repo_id long, ord long, negated boolean, regex string"
    )
    # One list per repository, as long as its ignore file.
    return rules.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("ord", "negated", "regex"))).alias("rules"))


def path_prefixes(path: Column | str) -> Column:
    """The path itself and all directories above it."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def is_ignored(path: Column | str, rules: Column | str) -> Column:
    """The last matching rule decides; a path below an ignored directory is ignored for good."""
    rule_list = F.coalesce(col(rules), F.array().cast("array<struct<ord:bigint,negated:boolean,regex:string>>"))

    def decided(prefix: Column) -> Column:
        return F.aggregate(
            rule_list,
            F.lit(False),
            lambda ignored, rule: F.when(F.rlike(prefix, rule["regex"]), ~rule["negated"]).otherwise(ignored),
        )

    return F.exists(path_prefixes(path), decided)


def filter_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no ignore rule of their repository drops.

    The rules are stored first: where their size allows, they are sent to the
    files, whose contents stay where they are.
    """
    return files.join(materialize(rules, "ignore-rules"), "repo_id", "left").where(~is_ignored("path", "rules")).select(*files.columns)


def discover(files: DataFrame, ignore_lines: DataFrame, langs: Sequence[str] = ()) -> DataFrame:
    """Source files to index: hidden and ignored paths dropped, language known."""
    return with_lang(filter_ignored(drop_hidden(files), ignore_rules(ignore_lines)), langs)


def go_module(files: DataFrame) -> DataFrame:
    """(repo_id, module): first ``module`` line of the root go.mod, ``unknown`` without one."""
    mods = files.where("path = 'go.mod'").select(
        "repo_id",
        F.trim(F.regexp_extract(F.col("content").cast("string"), r"(?m)^\s*module ([^\r\n]*)", 1)).alias("found"),
    )
    repos = files.select("repo_id").distinct()
    return repos.join(mods, "repo_id", "left").select(
        "repo_id", F.coalesce(F.nullif("found", F.lit("")), F.lit("unknown")).alias("module")
    )
