"""Streaming runs over the driver tables, drained once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import content_hash
from loomgraph.plans.markup_queries import PART_IDS, STYLE_NAMES, heading_extractor
from loomgraph.plans.note_queries import BLANKS, content_key
from loomgraph.plans.registry import Tables, query
from loomgraph.session import scratch_root, shuffles_removed
from loomgraph.sources.tables import read_edges, read_table
from loomgraph.streaming import indexing, notes


def _folder(t: Tables, name: str) -> str:
    return f"{scratch_root(t.spark)}/{name}-{uuid.uuid4().hex}"


def _table_stream(t: Tables, name: str) -> DataFrame:
    """A driver table, one file or a folder of part files, read as a stream of its files."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet").schema
    # A stream takes a plain path only for a folder; a pattern may match a file as well.
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}[.]parquet")


TURN = f"strlen(trim(text, {BLANKS})) BETWEEN 50 AND 5000"


@query(
    "stream_notes",
    f"SELECT {content_key('text')} AS content_hash, count(*) AS requests, CAST(1 AS BIGINT) AS stored FROM {{conversations}} WHERE {TURN} GROUP BY 1",
)
def stream_notes(t: Tables) -> DataFrame:
    """Conversation turns as store requests: each content is stored once, later copies are refused."""
    rows = _table_stream(t, "conversations").select(
        F.lit("store").alias("op"),
        F.concat_ws("-", "conv_id", "turn").alias("req_id"),
        F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"),
        F.lit(None).cast("string").alias("id"),
        F.concat(F.lit("Conversation "), "conv_id", F.lit(" turn "), "turn").alias("title"),
        F.col("text").alias("content"),
        F.array("role").alias("tags"),
        F.lit(False).alias("tags_provided"),
        F.lit("global").alias("scope"),
    )
    base = _folder(t, "note-store")
    notes.start(rows, base, _folder(t, "note-checkpoint"), available_now=True).awaitTermination()
    done = notes.read_outcomes(t.spark, base).where("code <> 'VALIDATION_ERROR'").select("req_id", "code")
    texts = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("req_id"), content_hash("text").alias("content_hash"))
    return (
        done.join(texts, "req_id")
        .groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("code") == "OK").alias("stored"))
    )


MIXED = (
    "WITH r AS (SELECT s_suppkey AS k, 'Supplier note number ' || CAST(s_suppkey AS VARCHAR) AS title, 'What there is to know about supplier number ' || CAST(s_suppkey AS VARCHAR) || ' and its nation' AS content FROM {supplier}) "
    "SELECT 's' || CAST(k AS VARCHAR) AS id, CASE WHEN k % 3 = 0 THEN 'Renamed supplier note ' || CAST(k AS VARCHAR) ELSE title END AS title, "
    "CASE WHEN k % 3 = 1 THEN content || ', now changed' ELSE content END AS content FROM r"
)


@query("stream_note_updates", MIXED)
def stream_note_updates(t: Tables) -> DataFrame:
    """Stores and updates in one stream: a third of the notes is renamed, a third rewritten; the rest aims at a title that is taken, or at no note."""
    rows = _table_stream(t, "supplier")
    k = F.col("s_suppkey")
    title = F.concat(F.lit("Supplier note number "), k)
    content = F.concat(F.lit("What there is to know about supplier number "), k, F.lit(" and its nation"))
    at = F.timestamp_seconds(k.cast("long") * 10)
    none, no_tags = F.lit(None).cast("string"), F.array().cast("array<string>")

    def request(op: str, when, note, title, content) -> Column:
        return F.struct(
            F.lit(op).alias("op"), F.concat(F.lit(op), k).alias("req_id"), when.alias("ts"), note.alias("id"), title.alias("title"), content.alias("content"),
            no_tags.alias("tags"), F.lit(False).alias("tags_provided"), (F.lit("global") if op == "store" else none).alias("scope"),
        )

    both = F.array(
        request("store", at, none, title, content),
        request(
            "update", at + F.expr("INTERVAL 1 SECOND"), F.when((k % 3 == 2) & (k % 2 == 0), F.lit("gone")).otherwise(F.concat(F.lit("store"), k)),
            F.when(k % 3 == 0, F.concat(F.lit("Renamed supplier note "), k)).when(k % 3 == 2, F.concat(F.lit("Supplier note number "), k - 1)),
            F.when(k % 3 == 1, F.concat(content, F.lit(", now changed"))),
        ),
    )
    requests = rows.select(F.explode(both).alias("r")).select("r.*")
    base = _folder(t, "mixed-notes")
    notes.start(requests, base, _folder(t, "mixed-checkpoint"), available_now=True).awaitTermination()
    return notes.current_notes(t.spark, base).select(F.replace("id", F.lit("store"), F.lit("s")).alias("id"), "title", "content")


@query(
    "stream_index",
    "SELECT 'site/p' || CAST(page_id AS VARCHAR) || '.html#' || CAST(i - 1 AS VARCHAR) AS fqn, names[i] AS name FROM "
    "(SELECT page_id, regexp_extract_all(html, '<h1>(.*?)</h1>', 1, 's') AS names FROM {pages}) p, unnest(range(1, len(names) + 1)) AS u(i)",
)
def stream_index(t: Tables) -> DataFrame:
    """Pages as a stream of files, indexed with a heading extractor."""
    files = _table_stream(t, "pages").select(
        F.lit(1).cast("long").alias("repo_id"), F.concat(F.lit("site/p"), "page_id", F.lit(".html")).alias("path"),
        F.col("page_id").alias("mtime"), F.octet_length("html").cast("long").alias("size"), F.col("html").cast("binary").alias("content"),
    )
    base = _folder(t, "graph-store")
    indexing.start(files, base, _folder(t, "graph-checkpoint"), {"html": heading_extractor}, available_now=True).awaitTermination()
    return read_table(t.spark, base, "symbols").select("fqn", "name")


def linked_extractor(content: str, path: str, repo_id: int) -> dict:
    """A page as a class with one function, which calls the functions of another name."""
    no = int("".join(c for c in path if c.isdigit()))
    owner, name = path.removesuffix(".js"), f"u{no * 7 % 50}"
    return {
        "symbols": [
            {"kind": "class", "name": owner.split("/")[-1], "fqn": owner},
            {"kind": "function", "name": name, "fqn": f"{owner}.{name}", "start_byte": 0, "end_byte": len(content), "start_line": 1, "end_line": 1},
        ],
        "callsites": [{"callee_text": f"x.u{no % 50}", "start_byte": 1, "end_byte": 2, "confidence": 0.5, "provenance": "page"}],
    }


PAGE_FN = "'site/p' || CAST({x}.page_id AS VARCHAR) || '.u' || CAST({x}.page_id * 7 % 50 AS VARCHAR)"


@query(
    "stream_edges",
    f"SELECT 'CONTAINS' AS kind, 'site/p' || CAST(a.page_id AS VARCHAR) AS src, {PAGE_FN.replace('{x}', 'a')} AS dst FROM {{pages}} a UNION ALL "
    f"SELECT 'CALLS', {PAGE_FN.replace('{x}', 'a')}, {PAGE_FN.replace('{x}', 'b')} FROM {{pages}} a JOIN {{pages}} b ON b.page_id * 7 % 50 = a.page_id % 50",
)
def stream_edges(t: Tables) -> DataFrame:
    """Pages that arrive in two parts: the edges between all of them, derived part by part."""
    arriving = _folder(t, "arriving-pages")
    with shuffles_removed(t.spark):
        t.pages.repartition(2, "page_id").write.parquet(arriving)
    files = t.spark.readStream.schema(t.pages.schema).option("maxFilesPerTrigger", 1).parquet(arriving).select(
        F.lit(1).cast("long").alias("repo_id"), F.concat(F.lit("site/p"), "page_id", F.lit(".js")).alias("path"),
        F.col("page_id").alias("mtime"), F.octet_length("html").cast("long").alias("size"), F.col("html").cast("binary").alias("content"),
    )
    base = _folder(t, "graph-store")
    indexing.start(files, base, _folder(t, "graph-checkpoint"), {"javascript": linked_extractor}, available_now=True).awaitTermination()
    names = read_table(t.spark, base, "symbols").select("id", "fqn")
    return read_edges(t.spark, base, labels=names).select("kind", F.col("src_fqn").alias("src"), F.col("dst_fqn").alias("dst"))


WEB = " UNION ALL ".join((
    f"SELECT 'html' AS lang, 'id' AS kind, name, 'web/' || lower(p_type) || '/p' || CAST(p_partkey AS VARCHAR) || '#' || name AS fqn FROM ({PART_IDS}) i JOIN {{part}} ON p_partkey = i.file_id",
    "SELECT 'javascript', 'function', 'show', 'web/' || lower(p_type) || '/p' || CAST(p_partkey AS VARCHAR) || '.show' FROM {part}",
    f"SELECT 'css', kind, name, 'css/' || lower(c_mktsegment) || '/c' || CAST(n.c_custkey AS VARCHAR) || mark || name FROM ({STYLE_NAMES}) n JOIN {{customer}} c ON c.c_custkey = n.c_custkey",
))


@query("index_web_files", WEB)
def index_web_files(t: Tables) -> DataFrame:
    """Pages and style sheets indexed without an extractor: the built-in one."""
    files = t.markup_files.unionByName(t.style_files).select(
        "repo_id", "path", F.lit(1).cast("long").alias("mtime"), F.length("content").cast("long").alias("size"), F.encode("content", "UTF-8").alias("content"),
    )
    base = _folder(t, "web-store")
    indexing.index_once(t.spark, base, files, {})
    return read_table(t.spark, base, "symbols").select("lang", "kind", "name", "fqn")
