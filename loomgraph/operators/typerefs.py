"""Type mentions of Java and Go resolved through the imports of their files.

Mentions are rows (repo_id, file_id, src_fqn, type_text, package); imports are
rows of their own.  Both are joined by file, so that a file's alias map is never
one row.  The result is rows (repo_id, file_id, src_fqn, ref_text), each once, as
the type refs of an extractor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import SKIPPED_TYPES, import_class, is_identifier, is_noise, resolve_types, simple_name, strip_generics
from loomgraph.operators.skew import salted_join

FILE = ["repo_id", "file_id"]
#: Words of Go type expressions that are no types.
GO_TYPE_WORDS = ("map", "chan", "func", "struct", "interface")
GO_NAME = r"[\p{L}_][\p{L}\p{N}_]*"


def class_imports(imports: DataFrame) -> DataFrame:
    """(repo_id, file_id, type_name, imported) of Java import statements (repo_id, file_id, pos, text); the last one of a name counts."""
    # exploded, so that the patterns run once a row and not in every later use
    found = imports.select(*FILE, "pos", F.explode(F.array(import_class("text"))).alias("imported")).where("imported IS NOT NULL")
    return found.groupBy(*FILE, simple_name("imported").alias("type_name")).agg(F.max_by("imported", "pos").alias("imported"))


def java_type_refs(mentions: DataFrame, imports: DataFrame) -> DataFrame:
    """Java types: the imported class, else the name in the own package, else the bare name; built-in names and self-references are dropped."""
    named = mentions.select(*FILE, "src_fqn", "package", F.explode(F.array(strip_generics("type_text"))).alias("type_name")).where(is_identifier("type_name"))
    named = named.where(~is_noise(F.lit("java"), "type_name", SKIPPED_TYPES)).select(*FILE, "src_fqn", "package", "type_name").distinct()
    known = salted_join(named, class_imports(imports), [*FILE, "type_name"], "left")
    return resolve_types(known).select(*FILE, "src_fqn", F.col("resolved").alias("ref_text")).distinct()


def package_aliases(imports: DataFrame) -> DataFrame:
    """(repo_id, file_id, alias, path) of Go imports (repo_id, file_id, pos, alias, path); without an alias it is the last part of the path.

    Dot and blank imports give no alias.
    """
    alias = F.coalesce("alias", F.substring_index("path", "/", -1))
    found = imports.where("path IS NOT NULL").select(*FILE, "pos", "path", alias.alias("alias")).where("alias NOT IN ('.', '_', '')")
    return found.groupBy(*FILE, "alias").agg(F.max_by("path", "pos").alias("path"))


def go_type_refs(mentions: DataFrame, imports: DataFrame) -> DataFrame:
    """Go types: every name in a type expression, in its package or in that of its alias; names of unknown aliases are dropped.

    ``package`` is the FQN of the mentioning file's package.  Lengths of arrays
    are no types; arguments of generics and keys of maps are.
    """
    bare = F.regexp_replace(F.regexp_replace("type_text", r"\bmap\s*\[", "("), r"(?<![\p{L}\p{N}_])\[[^\[\]]*\]", " ")
    found = F.regexp_extract_all(bare, F.lit(rf"(?:{GO_NAME}\s*\.\s*)?{GO_NAME}"), F.lit(0))
    names = mentions.select(*FILE, "src_fqn", "package", F.explode(found).alias("found")).select(
        *FILE, "src_fqn", "package", F.when(F.contains("found", F.lit(".")), F.trim(F.substring_index("found", ".", 1))).alias("alias"),
        F.trim(F.substring_index("found", ".", -1)).alias("name"),
    ).distinct()
    own = names.where("alias IS NULL").where(~is_noise(F.lit("go"), "name", SKIPPED_TYPES) & ~F.col("name").isin(*GO_TYPE_WORDS))
    other = salted_join(names.where("alias IS NOT NULL"), package_aliases(imports), [*FILE, "alias"])
    refs = own.select(*FILE, "src_fqn", F.concat_ws(".", "package", "name").alias("ref_text")).unionByName(
        other.select(*FILE, "src_fqn", F.concat_ws(".", "path", "name").alias("ref_text"))
    )
    return refs.where("src_fqn IS NULL OR ref_text <> src_fqn").distinct()
