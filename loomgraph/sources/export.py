"""Whole-graph reads and distributed JSON / GraphML export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import col
from loomgraph.operators.edges import cascade

# The frame of a GraphML document.
GRAPHML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/graphml">',
    '  <key id="node_kind" for="node" attr.name="kind" attr.type="string"></key>',
    '  <key id="name" for="node" attr.name="name" attr.type="string"></key>',
    '  <key id="fqn" for="node" attr.name="fqn" attr.type="string"></key>',
    '  <key id="lang" for="node" attr.name="lang" attr.type="string"></key>',
    '  <key id="edge_kind" for="edge" attr.name="kind" attr.type="string"></key>',
)
GRAPHML_TAIL = ("  </graph>", "</graphml>")


def edge_id() -> Column:
    return F.xxhash64(F.lit("edge"), "repo_id", "kind", "src", "dst")


def graph(
    symbols: DataFrame, edges: DataFrame, lang: str | None = None, prune_dangling: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Nodes of one language (or all) and the edges.

    Edges are not filtered by language, so some may lead to nodes that are left
    out; ``prune_dangling`` drops those.
    """
    nodes = symbols.where(F.col("lang") == lang) if lang else symbols
    return nodes, cascade(edges, nodes) if prune_dangling else edges


def json_nodes(nodes: DataFrame, repo: str) -> DataFrame:
    """One JSON object per node; empty FQN, signature and visibility are left out."""
    def optional(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).alias(name)

    body = F.to_json(
        F.struct(
            F.lit(repo).alias("repo"), "id", "lang", "kind", "name", optional("fqn"), optional("signature"),
            optional("visibility"), "start_line",
        ),
        {"ignoreNullFields": "true"},
    )
    return nodes.select("id", body.alias("line"))


def json_edges(edges: DataFrame, repo: str) -> DataFrame:
    """One JSON object per edge."""
    e = edges if "id" in edges.columns else edges.withColumn("id", edge_id())
    body = F.to_json(F.struct(F.lit(repo).alias("repo"), "id", "kind", "src", "dst", "confidence", "provenance"))
    return e.select("id", body.alias("line"))


def export_json(nodes: DataFrame, edges: DataFrame, repo: str, path: str) -> None:
    """Nodes and edges as JSON lines in ``<path>/nodes`` and ``<path>/edges``, in id order."""
    json_nodes(nodes, repo).orderBy("id").select("line").write.mode("overwrite").text(f"{path}/nodes")
    json_edges(edges, repo).orderBy("id").select("line").write.mode("overwrite").text(f"{path}/edges")


def xml_escape(c: Column | str) -> Column:
    """Text and attribute escaping."""
    out = F.coalesce(col(c).cast("string"), F.lit(""))
    for raw, safe in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"),
        ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;"),
    ):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _data(key: str, value: str) -> list[Column]:
    return [F.lit(f'      <data key="{key}">'), xml_escape(value), F.lit("</data>\n")]


def graphml_lines(nodes: DataFrame, edges: DataFrame, repo: str) -> DataFrame:
    """GraphML document as (part, id, line): head 0, nodes 1, edges 2, tail 3."""
    spark = nodes.sparkSession
    e = edges if "id" in edges.columns else edges.withColumn("id", edge_id())
    number = F.col("id").cast("string")
    node = F.concat(
        F.lit('    <node id="n'), number, F.lit('">\n'),
        *_data("node_kind", "kind"), *_data("name", "name"), *_data("fqn", "fqn"), *_data("lang", "lang"),
        F.lit("    </node>"),
    )
    edge = F.concat(
        F.lit('    <edge id="e'), number, F.lit('" source="n'), F.col("src").cast("string"),
        F.lit('" target="n'), F.col("dst").cast("string"), F.lit('">\n'), *_data("edge_kind", "kind"),
        F.lit("    </edge>"),
    )
    frame = spark.range(1).select(
        F.explode(F.array(
            F.struct(F.lit(0).alias("part"), F.concat(
                F.lit("\n".join(GRAPHML_HEAD) + '\n  <graph id="'), xml_escape(F.lit(repo)),
                F.lit('" edgedefault="directed">'),
            ).alias("line")),
            F.struct(F.lit(3).alias("part"), F.lit("\n".join(GRAPHML_TAIL)).alias("line")),
        )).alias("f")
    ).select("f.part", F.lit(0).cast("long").alias("id"), "f.line")
    return (
        frame.unionByName(nodes.select(F.lit(1).alias("part"), "id", node.alias("line")))
        .unionByName(e.select(F.lit(2).alias("part"), "id", edge.alias("line")))
    )


def export_graphml(nodes: DataFrame, edges: DataFrame, repo: str, path: str) -> None:
    """Write the document as part files that read in order give one GraphML text."""
    graphml_lines(nodes, edges, repo).orderBy("part", "id").select("line").write.mode("overwrite").text(path)
