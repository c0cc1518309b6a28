"""Note search: query cleaning, BM25 with fall-back to recency, re-ranking, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomgraph.functions.text import DEFAULT_SCOPE, clamp, col, round_score
from loomgraph.operators.skew import top_per_key
from loomgraph.operators.textindex import TextIndex, bm25, build_index, tokens
from loomgraph.session import materialize

# Field weights, limits and boosts of the note search.
WEIGHTS = {"title": 10.0, "content": 5.0, "tags": 1.0}
DEFAULT_LIMIT = 5
MAX_LIMIT = 20
OVERFETCH = 2
MIN_QUERY, MAX_QUERY = 3, 500
TAG_BOOST = 0.1
SCOPE_BOOST = 0.5
GLOBAL_BOOST = 0.2


def search_errors(query: Column | str = "query", limit: Column | str = "limit") -> Column:
    """Input errors of a search request; lengths are in bytes."""
    size = F.octet_length(F.coalesce(col(query), F.lit("")))
    return F.filter(
        F.array(
            F.when(size < MIN_QUERY, F.lit("query must be at least 3 characters")),
            F.when(size > MAX_QUERY, F.lit("query must be at most 500 characters")),
            F.when(col(limit) < 0, F.lit("limit must be a positive number")),
        ),
        lambda e: e.isNotNull(),
    )


def query_words(query: Column | str) -> Column:
    """Query text -> words: quotes doubled, operators blanked, AND / OR / NOT removed."""
    doubled = F.replace(col(query), F.lit('"'), F.lit('""'))
    blanked = F.regexp_replace(doubled, r"[*^():\-]", " ")
    plain = F.regexp_replace(blanked, r"(?i)(?<![a-z0-9_])(?:and|or|not)(?![a-z0-9_])", "")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != "")


def match_expression(query: Column | str) -> Column:
    """The full-text expression: every word with a trailing ``*``."""
    return F.array_join(F.transform(query_words(query), lambda w: F.concat(w, F.lit("*"))), " ")


def is_valid_expression(query: Column | str) -> Column:
    """False if a word holds a character the full-text syntax does not allow unquoted."""
    return ~F.exists(query_words(query), lambda w: w.rlike(r'[^A-Za-z0-9_"\x{1A}\x{80}-\x{10FFFF}]'))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term_no, words, is_prefix) of the queries.

    A word is cut at its doubled quotes; its last piece is a prefix unless a
    quote follows.  A piece that holds several tokens is a phrase; a piece
    without tokens is no term.
    """
    pieces = F.flatten(
        F.transform(
            query_words("query"),
            lambda w: F.transform(
                F.filter(F.split(w, '"+'), lambda p: p != ""),
                lambda p, i: F.struct(
                    tokens(p).alias("words"),
                    (~F.endswith(w, F.lit('"')) & (i == F.size(F.filter(F.split(w, '"+'), lambda x: x != "")) - 1)).alias(
                        "is_prefix"
                    ),
                ),
            ),
        )
    )
    return (
        queries.select("query_id", F.posexplode(pieces).alias("term_no", "t"))
        .select("query_id", "term_no", "t.words", "t.is_prefix")
        .where(F.size("words") > 0)
    )


def note_fields() -> dict[str, Column | str]:
    """The indexed fields of a note."""
    return {"title": "title", "content": "content", "tags": F.array_join("tags", " ")}


def index_notes(knowledge: DataFrame, stem: bool = True, stored: bool = False, once: bool = False) -> TextIndex:
    """Text index over title, content and tags of the notes."""
    return build_index(knowledge, "id", note_fields(), stem, stored, once)


def recent_notes(knowledge: DataFrame, queries: DataFrame) -> DataFrame:
    """Newest notes per query inside its scope: (query_id, id, bm25 = 0), 2 x limit rows each.

    The newest notes are first reduced to a fixed number per scope, so a query
    never meets the whole table.
    """
    most = MAX_LIMIT * OVERFETCH
    newest = [F.desc("created_at"), F.col("id")]
    base = knowledge.select("id", "scope", "created_at")
    per_scope = top_per_key(base, ["scope"], newest, most)
    overall = top_per_key(per_scope.withColumn("pool", F.lit("*")), ["pool"], newest, most)
    pool = overall.select("pool", "id", "created_at").unionByName(
        per_scope.select(F.col("scope").alias("pool"), "id", "created_at")
    )
    scoped = F.coalesce("scope", F.lit("")) != ""
    asks = queries.select(
        "query_id", "fetch",
        F.explode(
            F.when(scoped, F.array_distinct(F.array("scope", F.lit(DEFAULT_SCOPE)))).otherwise(F.array(F.lit("*")))
        ).alias("pool"),
    )
    return (
        top_per_key(asks.join(pool, "pool"), ["query_id"], newest, most)
        .withColumn("n", F.row_number().over(_per_query(*newest)))
        .where("n <= fetch")
        .select("query_id", "id", F.lit(0.0).alias("bm25"))
    )


def _per_query(*order: Column) -> WindowSpec:
    return Window.partitionBy("query_id").orderBy(*order)


def tag_boost(tags: Column | str, context: Column | str) -> Column:
    """1 + 0.1 for every context tag that the note has; a repeated context tag counts again."""
    own = F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), F.lower)
    asked = F.transform(F.coalesce(col(context), F.array().cast("array<string>")), F.lower)
    hits = F.size(F.filter(asked, lambda t: F.array_contains(own, t)))
    return F.lit(1.0) + hits.cast("double") * F.lit(TAG_BOOST)


def scope_boost(scope: Column | str, asked: Column | str) -> Column:
    s, q = col(scope), F.coalesce(col(asked), F.lit(""))
    return F.when((q != "") & (s == q), SCOPE_BOOST).when(s == DEFAULT_SCOPE, GLOBAL_BOOST).otherwise(0.0)


def rerank(hits: DataFrame) -> DataFrame:
    """Add ``score`` to rows with bm25, tags, context_tags, scope, query_scope."""
    return hits.withColumn(
        "score",
        round_score(F.col("bm25") * tag_boost("tags", "context_tags") + scope_boost("scope", "query_scope")),
    )


def search(knowledge: DataFrame, queries: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """Ranked notes for many search requests in one job.

    ``queries``: query_id, query, context_tags, scope, limit.  Returns
    (query_id, rank, id, title, content, tags, scope, score).  Invalid requests
    give no rows; ``search_errors`` says why.  A query without words, or one
    the full-text syntax rejects, lists the newest notes instead.
    """
    index = index or index_notes(knowledge, once=True)
    asked = materialize(
        queries.where(F.size(search_errors()) == 0)
        .withColumn("limit", clamp("limit", 1, MAX_LIMIT, DEFAULT_LIMIT))
        .withColumn("fetch", F.col("limit") * OVERFETCH)
        .withColumn("by_text", (F.size(query_words("query")) > 0) & is_valid_expression("query")),
        "search-requests",
    )
    by_text = asked.where("by_text")
    scored = bm25(index, query_terms(by_text), WEIGHTS).withColumnRenamed("doc_id", "id")
    in_scope = (
        scored.join(knowledge.select("id", "scope"), "id")
        .join(by_text.select("query_id", F.col("scope").alias("query_scope"), "fetch"), "query_id")
        .where("coalesce(query_scope, '') = '' OR scope = query_scope OR scope = 'global'")
    )
    best = [F.desc("bm25"), F.col("id")]
    by_score = (
        top_per_key(in_scope, ["query_id"], best, MAX_LIMIT * OVERFETCH)
        .withColumn("n", F.row_number().over(_per_query(*best)))
        .where("n <= fetch")
        .select("query_id", "id", "bm25")
    )
    # A few rows per request; stored, so that the planner sees how few before it reads the texts.
    fetched = materialize(by_score.unionByName(recent_notes(knowledge, asked.where("NOT by_text"))), "fetched-notes")
    full = fetched.join(knowledge.select("id", "title", "content", "tags", "scope"), "id").join(
        asked.select("query_id", "context_tags", F.col("scope").alias("query_scope"), "limit"), "query_id"
    )
    order = _per_query(F.desc("score"), F.col("id"))
    return (
        rerank(full)
        .withColumn("rank", F.row_number().over(order))
        .where("rank <= limit")
        .select("query_id", "rank", "id", "title", "content", "tags", "scope", "score")
    )
