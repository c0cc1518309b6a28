"""From documents to training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import language, line_dedup, packing, simhash, templates
from loomgraph.llm.arrow import session, table
from loomgraph.session import scratch_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or whose language is unclear; the network learns from the documents' own lang."""
    session(spark)
    return language.keep_known_languages(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines from the texts."""
    session(spark)
    return line_dedup.drop_repeated_lines(docs)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    session(spark)
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark questions."""
    return templates.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents' tokens in sequences."""
    session(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("line dedup", deduplicate_lines),
    ("SimHash near-dedup", deduplicate_documents),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: The stages train networks, hash with XXH64 and encode tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
    return docs
