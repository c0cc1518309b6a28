"""Fully qualified names, simple names, identifiers and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import col, trim_space

# Names that never produce a type reference, a call or a constructor call, by language.
GO_BUILTIN_TYPES = (
    "bool", "int", "int8", "int16", "int32", "int64",
    "uint", "uint8", "uint16", "uint32", "uint64", "uintptr",
    "float32", "float64", "complex64", "complex128",
    "string", "byte", "rune", "error",
    "any", "comparable",
)
JAVA_KEYWORDS = (
    "if", "else", "for", "while", "do",
    "switch", "case", "break", "continue",
    "return", "throw", "throws", "try",
    "catch", "finally", "new", "this",
    "super", "instanceof", "assert",
    "synchronized",
)
JAVA_SKIPPED_CONSTRUCTORS = (
    "String", "Integer", "Long", "Double",
    "Float", "Boolean", "Byte", "Short",
    "Character", "Object", "Class", "Number",
    "StringBuilder", "StringBuffer",
)
JAVA_SKIPPED_TYPES = (
    "void", "int", "long", "boolean", "double",
    "float", "char", "byte", "short",
    "String", "Integer", "Long", "Boolean",
    "Double", "Float", "Character", "Byte", "Short",
    "Object", "Class", "Number", "Enum",
    "StringBuilder", "StringBuffer", "CharSequence",
    "Throwable", "Exception", "RuntimeException", "Error",
    "Comparable", "Cloneable", "Serializable", "Iterable",
    "Override", "SuppressWarnings", "Deprecated",
    "T", "E", "K", "V", "R", "N",
)
JS_BUILTIN_TYPES = (
    "Array", "Object", "Function", "Promise", "Map", "Set", "WeakMap", "WeakSet",
    "Date", "Error", "RegExp", "Event", "Element", "Node", "Math", "JSON",
    "Boolean", "Number", "String", "Symbol", "BigInt", "null", "undefined",
    "HTMLElement", "EventTarget", "XMLHttpRequest", "URL", "Blob", "File",
    "Window", "Document", "console",
)
TS_BUILTIN_TYPES = (
    "string", "number", "boolean", "any", "void", "never", "unknown",
    "object", "symbol", "bigint", "null", "undefined",
    "Array", "Promise", "Record", "Map", "Set", "Function",
    "Object", "Date", "Error", "RegExp", "Event",
)

#: Names excluded from type references, by language.
SKIPPED_TYPES = {
    "go": GO_BUILTIN_TYPES,
    "java": JAVA_SKIPPED_TYPES,
    "javascript": JS_BUILTIN_TYPES,
    "typescript": TS_BUILTIN_TYPES,
}
#: Names excluded from calls, and from constructor calls, by language.
SKIPPED_CALLS = {"java": JAVA_KEYWORDS}
SKIPPED_CONSTRUCTORS = {"java": JAVA_SKIPPED_CONSTRUCTORS}


def is_noise(lang: Column | str, name: Column | str, table: dict[str, tuple[str, ...]]) -> Column:
    """True for a built-in name of the row's language."""
    test = F.lit(False)
    for key, names in table.items():
        test = F.when(col(lang) == key, col(name).isin(*names)).otherwise(test)
    return test


def is_skipped_call(lang: Column | str, name: Column | str, is_constructor: Column | str) -> Column:
    """True for a keyword taken for a call, or the constructor call of a built-in class."""
    return F.when(col(is_constructor), is_noise(lang, name, SKIPPED_CONSTRUCTORS)).otherwise(is_noise(lang, name, SKIPPED_CALLS))


def callee_key(c: Column | str, last: bool = False) -> Column:
    """Name a call is matched by: the text after the first dot, or after the last one."""
    text = col(c)
    if last:
        return F.substring_index(text, ".", -1)
    dot = F.instr(text, ".")
    return F.when(dot > 0, F.substring(text, dot + 1, F.length(text))).otherwise(text)


def receiver_owner(fqn: Column | str) -> Column:
    """``pkg.(Type).method`` -> ``pkg.Type``; NULL for names without a receiver."""
    pattern = r"^(.*?)\.\((.*?)\)\..*$"
    f = col(fqn)
    return F.when(f.rlike(pattern), F.regexp_replace(f, pattern, "$1.$2"))


def parent_by_name(fqn: Column | str, name: Column | str) -> Column:
    """FQN with the trailing ``.name`` cut off by length."""
    f = col(fqn)
    return F.substring(f, F.lit(1), F.length(f) - F.length(col(name)) - 1)


def parent_if_suffix(fqn: Column | str, name: Column | str) -> Column:
    """Like ``parent_by_name``, but NULL unless the FQN really ends with ``.name``."""
    f = col(fqn)
    return F.when(F.endswith(f, F.concat(F.lit("."), col(name))), parent_by_name(f, name))


def hash_owner(fqn: Column | str) -> Column:
    """Part before ``#``: the type that owns a method or constructor."""
    return F.substring_index(col(fqn), "#", 1)


def strip_generics(c: Column | str) -> Column:
    """Type text without ``<...>``; array brackets at the end are kept.

    A plain name is its own result; without a bracket the patterns are spared.
    """
    text = trim_space(c)
    arrays = F.regexp_replace(F.regexp_extract(text, r"((?:\s*\[\])*)$", 1), r"\s", "")
    base = F.regexp_replace(text, r"(?:\s*\[\])*$", "")
    bare = trim_space(F.substring_index(text, "<", 1))
    whole = F.concat(trim_space(F.substring_index(base, "<", 1)), arrays)
    plain = col(c).rlike(r"\A[A-Za-z0-9_$.]*\z")
    return F.when(plain, col(c)).when(F.contains(text, F.lit("[")), whole).otherwise(bare)


def split_top_level(c: Column | str) -> Column:
    """Split on commas outside ``<...>``; parts are trimmed, empty parts dropped."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts")
    )

    def step(state: Column, ch: Column) -> Column:
        cut = (ch == ",") & (state["depth"] == 0)
        return F.struct(
            (state["depth"] + F.when(ch == "<", 1).when(ch == ">", -1).otherwise(0)).alias("depth"),
            F.when(cut, "").otherwise(F.concat(state["part"], ch)).alias("part"),
            F.when(cut, F.array_append(state["parts"], state["part"])).otherwise(state["parts"]).alias("parts"),
        )

    parts = F.aggregate(
        F.split(col(c), ""), start, step, lambda state: F.array_append(state["parts"], state["part"])
    )
    return F.filter(F.transform(parts, trim_space), lambda p: p != "")


def simple_name(c: Column | str) -> Column:
    """Last dot component, without generics."""
    return trim_space(F.substring_index(strip_generics(c), ".", -1))


def is_identifier(c: Column | str) -> Column:
    """ASCII letter, ``_``, ``$`` or any non-ASCII character first; digits may follow."""
    return F.coalesce(col(c).rlike(r"^[A-Za-z_$\x{80}-\x{10FFFF}][A-Za-z0-9_$\x{80}-\x{10FFFF}]*$"), F.lit(False))


def go_visibility(name: Column | str) -> Column:
    """Exported names start with an upper-case letter."""
    return F.when(col(name).rlike(r"^\p{Lu}"), "public").otherwise("private")


def java_visibility(modifiers: Column | str) -> Column:
    """First of public, protected, private found in the modifiers, else package."""
    m = F.coalesce(col(modifiers), F.lit(""))
    return (
        F.when(F.contains(m, F.lit("public")), "public")
        .when(F.contains(m, F.lit("protected")), "protected")
        .when(F.contains(m, F.lit("private")), "private")
        .otherwise("package")
    )


def import_package(c: Column | str) -> Column:
    """Java import statement text -> imported package; NULL for static imports.

    ``import a.b.*;`` gives ``a.b``, ``import a.b.C;`` gives ``a.b``; an import
    without a dot names no package.
    """
    text = col(c)
    path = trim_space(F.regexp_extract(text, r"import\s+([^;]+)", 1))
    return F.when(
        ~F.contains(text, F.lit("import static ")) & path.contains("."),
        F.regexp_replace(path, r"\.[^.]*$", ""),
    )


def import_class(c: Column | str) -> Column:
    """Fully qualified class of a single-class Java import, NULL otherwise."""
    text = col(c)
    path = trim_space(F.regexp_extract(text, r"import\s+([^;]+)", 1))
    return F.when(~F.contains(text, F.lit("import static ")) & path.rlike(r"\.[A-Z][^.]*$"), path)


def resolve_types(rows: DataFrame) -> DataFrame:
    """Add ``resolved``: the imported class, else the name in the own package, else the bare name.

    ``rows`` has type_name, imported, package and src_fqn; a type that refers to
    itself is dropped.
    """
    own = F.when(F.coalesce("package", F.lit("")) != "", F.concat("package", F.lit("."), "type_name"))
    resolved = F.coalesce(F.col("imported"), own, F.col("type_name"))
    return rows.withColumn("resolved", resolved).where("src_fqn IS NULL OR resolved <> src_fqn")
