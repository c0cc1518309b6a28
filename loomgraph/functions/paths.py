"""Path, extension and location functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import col

# File extension (lower case) -> language.
EXTENSION_LANG = {
    ".go": "go",
    ".java": "java",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
}

LANGS = ("go", "java", "javascript", "typescript", "html", "css")


def to_slash(c: Column | str) -> Column:
    """Forward slashes only."""
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def relative_path(path: Column | str, root: Column | str) -> Column:
    """Path below ``root``; a path outside the root is returned unchanged."""
    p = to_slash(path)
    prefix = F.concat(F.rtrim(to_slash(root), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(p, prefix), F.substring(p, F.length(prefix) + 1, F.length(p))).otherwise(p)


def file_extension(path: Column | str) -> Column:
    """Last extension of the base name, lower-case, with its dot ('' if none)."""
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]*)$", 1))


def classify_lang(path: Column | str) -> Column:
    """Language of a source path, NULL for other files."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSION_LANG.items() for x in pair])
    return F.try_element_at(table, file_extension(path))


def module_name(path: Column | str) -> Column:
    """``<dir>/<base without extension>``: the prefix of page and script FQNs."""
    return F.regexp_replace(to_slash(path), r"\.[^./]*$", "")


def uri_to_path(uri: Column | str, root: Column | str) -> Column:
    """``file://`` location to a repository-relative path."""
    plain = F.regexp_replace(col(uri), "^file://", "")
    r = to_slash(root)
    return relative_path(plain, F.when(F.startswith(r, F.lit("/")), r).otherwise(F.concat(F.lit("/"), r)))


def line_after(before: Column | str) -> Column:
    """1-based line of the position that follows the text ``before``."""
    b = col(before)
    return F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))) + 1


def column_after(before: Column | str) -> Column:
    """1-based byte column of the position that follows the text ``before``."""
    return F.octet_length(F.substring_index(col(before), "\n", -1)) + 1


LOCATION = "struct<uri:string,range:struct<start:struct<line:int,character:int>>>"
LINK = "struct<targetUri:string,targetSelectionRange:struct<start:struct<line:int,character:int>>>"


def parse_locations(raw: Column | str) -> Column:
    """Definition result in any of its three JSON shapes -> array<struct<uri,line>>.

    Accepts a list of locations, one location, or a list of location links;
    lines come out 1-based.  ``null``, empty lists and bad JSON give an empty array.
    """
    r = col(raw)
    many = F.from_json(r, f"array<{LOCATION}>")
    one = F.from_json(r, LOCATION)
    links = F.from_json(r, f"array<{LINK}>")
    as_many = F.transform(
        F.filter(many, lambda x: x["uri"].isNotNull()),
        lambda x: F.struct(x["uri"].alias("uri"), (x["range"]["start"]["line"] + 1).alias("line")),
    )
    as_one = F.array(F.struct(one["uri"].alias("uri"), (one["range"]["start"]["line"] + 1).alias("line")))
    as_links = F.transform(
        F.filter(links, lambda x: x["targetUri"].isNotNull()),
        lambda x: F.struct(
            x["targetUri"].alias("uri"), (x["targetSelectionRange"]["start"]["line"] + 1).alias("line")
        ),
    )
    none = F.array().cast("array<struct<uri:string,line:int>>")
    return F.coalesce(
        F.when(F.size(as_many) > 0, as_many),
        F.when(one["uri"].isNotNull() & (one["uri"] != ""), as_one),
        F.when(F.size(as_links) > 0, as_links),
        none,
    )
