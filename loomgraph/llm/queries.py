"""Registered queries of the operators: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import (
    bitsliced, grammar, hyperminhash, language, licenses, packing, periodic, prefix_counts, rtree, simhash, templates, toxicity, word_runs,
)
from loomgraph.llm.arrow import table
from loomgraph.session import scratch_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its SQL."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query("op10_prefix_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > prefix_counts.BUDGET).alias("over_limit"), "fit_chars")


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_repair_token_output")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/token-shards-{uuid.uuid4().hex}"
    grammar.write_shards(table(spark, sf_dir, "documents"), path)
    return grammar.read_documents(spark, path)


@query("op4_sum_of_squares_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_byte_cnn_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.is_held_out().alias("held_out"), "lang_pred", "score")


@query("op9_kneser_ney_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", language.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query("op8_winnowing_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.dedup_runs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "removed_lines", "removed_words", "runs")


@query("op7_template_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), dense=True)


@query("op5_license_sentences", licenses.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""


@query("op1_bit_sliced_top_k", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
good AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM p WHERE same),
r AS (SELECT g.anchor_id, g.vec_id AS positive_id, p.vec_id AS negative_id, g.score AS positive_score, p.score AS negative_score,
        row_number() OVER (PARTITION BY g.anchor_id, g.vec_id ORDER BY p.score DESC, p.vec_id) AS n
      FROM good g JOIN p ON g.n <= 5 AND p.anchor_id = g.anchor_id AND NOT p.same AND 50 * g.score <= 100 * p.score AND 100 * p.score <= 95 * g.score)
SELECT anchor_id, positive_id, n::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE n <= 3
"""


@query("op11_rtree_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


@query("op12_hyperminhash_near_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def repeating(docs: DataFrame) -> DataFrame:
    """The documents, those whose h = crc32(doc_id) ends with 0 repeating their words from a on with period p."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.when(F.size("words") > 0, F.size("words"))
    docs = docs.select("*", (F.col("g") % n).cast("int").alias("a"))
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    period = F.slice("words", F.col("a") + 1, p)
    times = F.ceil((n - F.col("a")) / p).cast("int")
    whole = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(period, times))), F.lit(1), n)
    return docs.select("doc_id", F.when(n > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(repeating(table(spark, sf_dir, "documents")))
    # length / period as exact fractions: x is before y if x.length * y.period > y.length * x.period
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
        lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit("")), 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length DIV best.period")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
