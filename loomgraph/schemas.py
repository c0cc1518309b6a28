"""Explicit table contracts; nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

_SPAN = [
    T.StructField("start_line", T.IntegerType()),
    T.StructField("start_col", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("end_col", T.IntegerType()),
    T.StructField("start_byte", T.LongType()),
    T.StructField("end_byte", T.LongType()),
]

REPOS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("root_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

FILES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("repo_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("indexed_at", T.TimestampType()),
])

SYMBOLS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("repo_id", T.LongType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("lang", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("fqn", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("visibility", T.StringType()),
    T.StructField("doc", T.StringType()),
    T.StructField("body_hash", T.StringType()),
    *_SPAN,
])

#: Symbols as extracted, one row per file that mentions them; SYMBOLS is their merged view.
SYMBOL_ROWS = T.StructType([
    *SYMBOLS.fields,
    T.StructField("path", T.StringType()),
    T.StructField("seq", T.IntegerType()),
])

EDGES = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("provenance", T.StringType()),
])

#: The two ends of the derived calls: every caller (callee false) calls every callee of its repository and name.
CALL_ENDS = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("callee", T.BooleanType()),
    T.StructField("id", T.LongType()),
])

CALLSITES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("repo_id", T.LongType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("caller", T.LongType()),
    T.StructField("callee_text", T.StringType()),
    *_SPAN,
    T.StructField("resolved", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("provenance", T.StringType()),
])

REFS = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("ref_text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("provenance", T.StringType()),
])

KNOWLEDGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("scope", T.StringType()),
    T.StructField("normalized_title", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

STORE_REQUEST = T.StructType([
    T.StructField("req_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("scope", T.StringType()),
])

UPDATE_REQUEST = T.StructType([
    T.StructField("req_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("tags_provided", T.BooleanType()),
    T.StructField("scope", T.StringType()),
])

SEARCH_REQUEST = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("context_tags", T.ArrayType(T.StringType())),
    T.StructField("scope", T.StringType()),
    T.StructField("limit", T.IntegerType()),
])

#: What a per-language extractor returns for one file (seven repeated groups).
FILE_EXTRACT = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("src_pkg_fqn", T.StringType()),
    T.StructField("symbols", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("fqn", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("doc", T.StringType()),
        *_SPAN,
    ]))),
    T.StructField("callsites", T.ArrayType(T.StructType([
        T.StructField("callee_text", T.StringType()),
        *_SPAN,
        T.StructField("confidence", T.DoubleType()),
        T.StructField("provenance", T.StringType()),
    ]))),
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("extends", T.ArrayType(T.StructType([
        T.StructField("src_fqn", T.StringType()),
        T.StructField("ref_text", T.StringType()),
    ]))),
    T.StructField("implements", T.ArrayType(T.StructType([
        T.StructField("src_fqn", T.StringType()),
        T.StructField("ref_text", T.StringType()),
    ]))),
    T.StructField("type_refs", T.ArrayType(T.StructType([
        T.StructField("src_fqn", T.StringType()),
        T.StructField("ref_text", T.StringType()),
    ]))),
    T.StructField("parse_error", T.StringType()),
])
