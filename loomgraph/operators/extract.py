"""Markup extraction as column expressions: HTML ids, links, custom elements, script calls, CSS names.

Input rows are files: repo_id, file_id, path, content.  The script rules are
heuristics on text with comments and strings blanked, not a parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.paths import module_name
from loomgraph.functions.text import col
from loomgraph.operators import brackets
from loomgraph.schemas import FILE_EXTRACT

COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>(.*?)</script\s*>"
STYLE = r"(?is)<style((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>(.*?)</style\s*>"
START_TAG = r"<([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>"
ATTRIBUTE = r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?"

JS_IMPORT = r"\bimport\b[^;'\"()]*['\"]([^'\"]+)['\"]|\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
#: Words that look like calls but are statements.
JS_STATEMENTS = ("if", "for", "while", "switch", "catch", "return", "typeof", "function", "with", "super", "import", "require")

FILE_KEY = ("repo_id", "file_id", "path")


def blank(text: Column, pattern: str) -> Column:
    """Remove what the pattern matches, leaving one space."""
    return F.regexp_replace(text, pattern, " ")


def attribute(attrs: Column | str, name: str) -> Column:
    """First non-empty value of the attribute in the text of a start tag, NULL if none."""
    a = col(attrs)
    groups = [F.regexp_extract_all(a, F.lit(ATTRIBUTE), F.lit(i)) for i in range(1, 5)]
    pairs = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("name", "double", "single", "bare"))])
    values = F.transform(
        F.filter(pairs, lambda p: p["name"] == name),
        lambda p: F.concat(p["double"], p["single"], p["bare"]),
    )
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))


def start_tags(files: DataFrame) -> DataFrame:
    """Start tags outside comments, scripts and styles: (..., pos, tag, attrs)."""
    body = blank(blank(blank(F.col("content"), COMMENT), SCRIPT), STYLE)
    return files.select(
        *FILE_KEY, F.posexplode(F.regexp_extract_all(body, F.lit(START_TAG), F.lit(0))).alias("pos", "raw")
    ).select(
        *FILE_KEY, "pos",
        F.regexp_extract("raw", START_TAG, 1).alias("tag"), F.regexp_extract("raw", START_TAG, 2).alias("attrs"),
    )


def located_tags(files: DataFrame) -> DataFrame:
    """Start tags with their place: (..., start_line, start_col, start_byte, end_byte, tag, attrs).

    The text is cut in front of every tag, comment, script and style; running
    sums over the pieces of one file give bytes and lines.  Lines and columns
    count from 1, columns in bytes.
    """
    token = f"(?is)(<!--.*?-->|{SCRIPT[5:]}|{STYLE[5:]}|{START_TAG})"
    pieces = files.select(
        *FILE_KEY,
        F.posexplode(
            F.split(F.regexp_replace(F.translate("content", "\u0001", " "), token, "\u0001$1"), "\u0001")
        ).alias("pos", "piece"),
    )
    order = Window.partitionBy(*FILE_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("piece") - F.length(F.replace(F.col("piece"), F.lit("\n"), F.lit("")))
    tail = F.octet_length(F.substring_index("piece", "\n", -1))
    # Bytes since the last line break before this piece.
    seen = pieces.select(
        *FILE_KEY, "pos", "piece",
        F.coalesce(F.sum(F.octet_length("piece")).over(order), F.lit(0)).alias("start_byte"),
        (F.coalesce(F.sum(breaks).over(order), F.lit(0)) + 1).alias("start_line"),
        (F.sum(F.octet_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - tail).alias("after_break"),
        (breaks > 0).alias("has_break"),
    ).withColumn(
        "line_byte", F.coalesce(F.max(F.when(F.col("has_break"), F.col("after_break"))).over(order), F.lit(0))
    )
    tag = F.regexp_extract("piece", "^" + START_TAG, 0)
    return (
        seen.where("pos > 0").withColumn("raw", tag).where("raw <> ''")
        .withColumn("tag", F.regexp_extract("raw", START_TAG, 1))
        .where(~F.lower("tag").isin("script", "style"))
        .select(
            *FILE_KEY, "tag", F.regexp_extract("raw", START_TAG, 2).alias("attrs"),
            F.col("start_line").cast("int").alias("start_line"),
            (F.col("start_byte") - F.col("line_byte") + 1).cast("int").alias("start_col"),
            (F.col("start_line") + F.length("raw") - F.length(F.replace(F.col("raw"), F.lit("\n"), F.lit(""))))
            .cast("int").alias("end_line"),
            F.col("start_byte").cast("long").alias("start_byte"),
            (F.col("start_byte") + F.octet_length("raw")).cast("long").alias("end_byte"),
        )
    )


def _symbol(kind: Column | str, name: Column, fqn: Column, signature: Column, lang: str) -> list[Column]:
    return [
        F.lit(lang).alias("lang"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), name.alias("name"),
        fqn.alias("fqn"), signature.alias("signature"), F.lit("public").alias("visibility"),
    ]


PLACE = ("start_line", "start_col", "end_line", "start_byte", "end_byte")


def html_ids(files: DataFrame) -> DataFrame:
    """Element ids as symbols of kind ``id``."""
    tags = located_tags(files).withColumn("value", attribute("attrs", "id")).where("value IS NOT NULL")
    return tags.select(
        *FILE_KEY,
        *_symbol("id", F.col("value"), F.concat(module_name("path"), F.lit("#"), "value"),
                 F.concat("tag", F.lit("#"), "value"), "html"),
        *PLACE,
    )


def html_custom_elements(files: DataFrame) -> DataFrame:
    """Custom elements (a tag name with a hyphen) as call sites."""
    return located_tags(files).where(F.contains("tag", F.lit("-"))).select(
        *FILE_KEY, F.col("tag").alias("callee_text"), *PLACE,
        F.lit(0.5).alias("confidence"), F.lit("heuristic").alias("provenance"),
    )


def scripts(files: DataFrame) -> DataFrame:
    """Script elements: (..., pos, src, body); ``src`` is NULL for inline scripts."""
    html = blank(F.col("content"), COMMENT)
    attrs = F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))
    bodies = F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(2))
    return files.select(
        *FILE_KEY, F.posexplode(F.arrays_zip(attrs.alias("attrs"), bodies.alias("body"))).alias("pos", "s")
    ).select(*FILE_KEY, "pos", attribute("s.attrs", "src").alias("src"), F.col("s.body").alias("body"))


def html_imports(files: DataFrame) -> DataFrame:
    """Distinct imports per file: every href, script sources, imports of inline scripts."""
    links = start_tags(files).select(*FILE_KEY, attribute("attrs", "href").alias("ref_text"))
    code = scripts(files)
    sources = code.where("src IS NOT NULL").select(*FILE_KEY, F.col("src").alias("ref_text"))
    inner = code.where("src IS NULL").select(*FILE_KEY, F.explode(js_imports("body")).alias("ref_text"))
    return links.unionByName(sources).unionByName(inner).where("ref_text IS NOT NULL AND ref_text <> ''").distinct()


def first_imports(imports: DataFrame) -> DataFrame:
    """Per-file imports without repeats, in order of first appearance: (repo_id, file_id, ref_text, pos)."""
    return imports.groupBy("repo_id", "file_id", "ref_text").agg(F.min("pos").alias("pos"))


def js_comments_blanked(body: Column | str) -> Column:
    """Script text without comments; string literals are kept."""
    literal = r"('(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`)|//[^\n]*|(?s:/\*.*?\*/)"
    return F.regexp_replace(col(body), literal, "$1")


#: Comments, strings and templates of scripts; the string that begins first hides what is inside it.
JS_TOKEN = (
    r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
    r"|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
)


def js_imports(body: Column | str) -> Column:
    """Paths of ``import`` statements and ``require`` calls."""
    code = js_comments_blanked(body)
    one = F.regexp_extract_all(code, F.lit(JS_IMPORT), F.lit(1))
    two = F.regexp_extract_all(code, F.lit(JS_IMPORT), F.lit(2))
    return F.filter(F.zip_with(one, two, lambda a, b: F.concat(a, b)), lambda p: p != "")


def script_bodies(files: DataFrame) -> DataFrame:
    """Inline scripts with the place of their text: (..., no, body, written, at_byte, at_line, at_col); ``written`` are the file's own bytes."""
    token = f"(?is:{COMMENT[4:]}|<script(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>.*?</script\\s*>)"
    parts = files.select(*FILE_KEY, "content", brackets.cut_out("content", token).alias("parts"))
    # outer: the optimizer would also cut every text where it is read, to leave out those without a part
    found = parts.select(*FILE_KEY, "content", "parts", F.posexplode_outer("parts").alias("no", "raw")).where(F.col("raw").rlike(r"(?i)^<script"))
    head = F.regexp_extract("raw", r"^<(?i:script)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>", 0)
    body = F.regexp_replace(F.substring(F.col("raw"), F.length(head) + 1, F.length("raw")), r"(?i)</script\s*>$", "")
    found = found.select(
        *FILE_KEY, "content", "no", body.alias("body"), F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("no")), ""), head).alias("before"),
        attribute(F.regexp_replace(head, r"(?i)^<script|>$", ""), "src").alias("src"),
    ).where("src IS NULL")
    line, column = brackets.place_after(F.lit(1), F.lit(1), F.col("before"))
    at_byte = F.octet_length("before")
    written = F.substring(F.col("content").cast("binary"), at_byte + 1, F.octet_length("body"))
    return found.select(*FILE_KEY, "no", "body", written.alias("written"), at_byte.alias("at_byte"), line.alias("at_line"), column.alias("at_col"))


#: What tells inline scripts apart, and their places in the file.
SCRIPT_KEY = (*FILE_KEY, "no", "at_byte", "at_line", "at_col")


def js_pieces(files: DataFrame) -> DataFrame:
    """Pieces of inline scripts up to every bracket and semicolon, comments and strings blanked, brackets paired."""
    bodies = script_bodies(files).withColumn("code", brackets.masked("body", JS_TOKEN))
    return brackets.pieces(bodies, SCRIPT_KEY, "code", "(){}[];", source="written")


def _in_file(begin: Column, line: Column, column: Column, end: Column) -> list[Column]:
    """PLACE in the file of what begins at byte, line and column of an inline script and ends at ``end`` (byte, line)."""
    return [
        (F.col("at_line") + line - 1).cast("int").alias("start_line"),
        F.when(line == 1, F.col("at_col") + column - 1).otherwise(column).cast("int").alias("start_col"),
        (F.col("at_line") + end["line"] - 1).cast("int").alias("end_line"),
        (F.col("at_byte") + begin).cast("long").alias("start_byte"), (F.col("at_byte") + end["byte"]).cast("long").alias("end_byte"),
    ]


def inline_calls(files: DataFrame) -> DataFrame:
    """Calls in inline scripts as call sites with their places; statements, declarations and ``new`` are not calls.

    A call reaches from its name to the partner of its parenthesis.
    """
    name = r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*"
    opening = js_pieces(files).where("mark = '('").withColumn("tail", F.regexp_extract("piece", rf"(?:\b(?:function|new)\s+)?{name}\s*\($", 0))
    opening = opening.withColumn("callee_text", F.regexp_extract("tail", rf"^({name})\s*\($", 1)).where(
        (F.col("callee_text") != "") & ~F.col("callee_text").isin(*JS_STATEMENTS)
    )
    skipped = F.substring(F.col("piece"), F.lit(1), F.length("piece") - F.length("tail"))
    line, column = brackets.place_after(F.col("start_line"), F.col("start_col"), skipped)
    return opening.select(
        *FILE_KEY, "callee_text", *_in_file(F.col("start_byte") + F.octet_length(skipped), line, column, F.col("close")),
        F.lit(0.5).alias("confidence"), F.lit("heuristic").alias("provenance"),
    )


def inline_functions(files: DataFrame) -> DataFrame:
    """Functions declared in inline scripts as symbols with their places, from ``function`` to the closing brace."""
    declared = r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\($"
    # a body: a brace right behind a closing parenthesis, whose partner is behind a declared name
    bodies = js_pieces(files).where((F.col("mark") == "{") & (F.col("head.mark") == ")") & F.col("piece").rlike(r"^\s*\{$"))
    opening = F.col("head.piece").cast("string")
    found = bodies.withColumn("name", F.regexp_extract(opening, declared, 1)).where("name <> ''")
    skipped = F.regexp_replace(opening, declared, "")
    line, column = brackets.place_after(F.col("head.start_line"), F.col("head.start_col"), skipped)
    begin = F.col("head.start_byte") + F.octet_length(skipped)
    # the parameters as they are written
    return found.select(*FILE_KEY, "name", F.col("head.text").cast("string").alias("params"), *_in_file(begin, line, column, F.col("close"))).select(
        *FILE_KEY,
        *_symbol("function", F.col("name"), F.concat(module_name("path"), F.lit("."), "name"), F.concat("name", "params"), "javascript"),
        *PLACE,
    )


# --- CSS ---------------------------------------------------------------------

CSS_COMMENT = r"(?s)/\*.*?\*/"
CSS_IMPORT = r"@import\s+(?:url\(\s*)?(?:\"([^\"]*)\"|'([^']*)')"
#: Comments, strings and unquoted addresses.
CSS_TOKEN = (
    r"/\*(?s:.*?)(?:\*/|\z)|\"[^\"\\\n]*+(?:\\(?s:.)[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'|(?i:url)\([^\"'()]*+\)"
)
CSS_KEYFRAMES = r"^\s*@(?:-[a-z]+-)?keyframes\s+([\w-]+)\s*\{$"
CSS_VARIABLE = r"^\s*(--[\w-]+)\s*:"
#: One selector without combinators, pseudo classes or attributes; the last part counts.
CSS_CLASS = r"^(?:[\w*-]*(?:[.#][\w-]+)*)\.([\w-]+)$"
CSS_ID = r"^(?:[\w*-]*(?:[.#][\w-]+)*)#([\w-]+)$"


def css_symbols(files: DataFrame) -> DataFrame:
    """Class and id selectors, custom properties and keyframes as symbols with their places, at any depth of braces.

    A selector's place is the selector, a property's its declaration, that of
    keyframes the whole rule.  What is inside keyframes is no symbol.
    """
    code = files.select(*FILE_KEY, brackets.masked("content", CSS_TOKEN).alias("code"))
    cut = brackets.pieces(code, FILE_KEY, "code", "{};", around=CSS_KEYFRAMES).where("within IS NULL OR start_byte >= within")
    frames = F.regexp_extract("piece", CSS_KEYFRAMES, 1)
    is_frames = (F.col("mark") == "{") & (frames != "")
    bare = F.when(F.col("mark").isNotNull(), F.expr("substring(piece, 1, length(piece) - 1)")).otherwise(F.col("piece"))

    def entry(kind: str, mark: str, name: Column, before: Column, text: Column, end: Column | None = None) -> Column:
        lead = F.concat(before, F.regexp_extract(text, r"^\s*", 0))
        begin = F.col("start_byte") + F.octet_length(lead)
        line, column = brackets.place_after(F.col("start_line"), F.col("start_col"), lead)
        trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(mark).alias("mark"), name.alias("name"), line.cast("int").alias("start_line"), column.cast("int").alias("start_col"),
            (line + brackets.line_breaks(trimmed) if end is None else end["line"]).cast("int").alias("end_line"), begin.cast("long").alias("start_byte"),
            (begin + F.octet_length(trimmed) if end is None else end["byte"]).cast("long").alias("end_byte"),
        )

    def selector(text: Column, i: Column) -> Column:
        trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
        ahead = F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice("parts", F.lit(1), i), ","), F.lit(",")))
        return F.when(trimmed.rlike(CSS_CLASS), entry("class", ".", F.regexp_extract(trimmed, CSS_CLASS, 1), ahead, text)).when(
            trimmed.rlike(CSS_ID), entry("id", "#", F.regexp_extract(trimmed, CSS_ID, 1), ahead, text)
        )

    rows = cut.withColumn("bare", bare).withColumn("parts", F.split("bare", ","))
    at_rule = F.col("bare").rlike(r"^\s*@")
    picked = F.filter(F.transform("parts", selector), lambda e: e.isNotNull())
    variable = F.regexp_extract("bare", CSS_VARIABLE, 1)
    found = (
        F.when(is_frames, F.array(entry("keyframes", "@", frames, F.lit(""), F.col("bare"), F.col("close"))))
        .when((F.col("mark") == "{") & ~at_rule, picked)
        .when(F.coalesce(F.col("mark") != "{", F.lit(True)) & F.col("block").isNotNull() & (variable != ""), F.array(entry("variable", "", variable, F.lit(""), F.col("bare"))))
    )
    return rows.select(*FILE_KEY, F.explode_outer(found).alias("e")).where("e IS NOT NULL").select(
        *FILE_KEY,
        *_symbol(F.col("e.kind"), F.col("e.name"), F.concat(module_name("path"), "e.mark", "e.name"),
                 F.concat("e.kind", F.lit(" "), "e.name"), "css"),
        *[F.col(f"e.{c}") for c in PLACE],
    )


def css_imports(files: DataFrame) -> DataFrame:
    """Distinct quoted ``@import`` paths per file."""
    text = blank(F.col("content"), CSS_COMMENT)
    one = F.regexp_extract_all(text, F.lit(CSS_IMPORT), F.lit(1))
    two = F.regexp_extract_all(text, F.lit(CSS_IMPORT), F.lit(2))
    paths = F.zip_with(one, two, lambda a, b: F.concat(a, b))
    return files.select(*FILE_KEY, F.explode(paths).alias("ref_text")).where("ref_text <> ''").distinct()


def style_bodies(files: DataFrame) -> DataFrame:
    """Bodies of ``<style>`` elements as CSS files of the page."""
    bodies = F.regexp_extract_all(blank(F.col("content"), COMMENT), F.lit(STYLE), F.lit(2))
    return files.select(*FILE_KEY, F.explode(bodies).alias("content"))


# --- files as a whole ------------------------------------------------------------

#: Languages whose files ``markup`` takes apart.
MARKUP = ("html", "css")


def _as_group(rows: DataFrame, group: str) -> Column:
    """Rows as the items of one FILE_EXTRACT group, in the order of their places."""
    fields = FILE_EXTRACT[group].dataType.elementType
    item = F.struct(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    order = F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", item.alias("item"))))
    return F.transform(order, lambda o: o["item"])


def markup(files: DataFrame) -> DataFrame:
    """HTML and CSS files (repo_id, path, lang, content) as FILE_EXTRACT rows, in built-in functions.

    The functions of a page's inline scripts are a row of their own with the
    script's language; its calls are among the page's call sites.
    """
    own = ["repo_id", "path"]
    rows = files.where(F.col("lang").isin(*MARKUP)).withColumn("file_id", F.lit(0).cast("long"))
    html, css = rows.where("lang = 'html'"), rows.where("lang = 'css'")
    found = html_ids(html).unionByName(inline_functions(html)).unionByName(css_symbols(css))
    symbols = found.groupBy(*own, "lang").agg(_as_group(found, "symbols").alias("symbols"))
    calls = html_custom_elements(html).unionByName(inline_calls(html))
    calls = calls.groupBy(*own).agg(_as_group(calls, "callsites").alias("callsites"))
    imports = html_imports(html).unionByName(css_imports(css)).groupBy(*own).agg(F.sort_array(F.collect_set("ref_text")).alias("imports"))
    pages = rows.select(*own, "lang").join(symbols, [*own, "lang"], "left").join(calls, own, "left").join(imports, own, "left")
    scripts_ = symbols.where(~F.col("lang").isin(*MARKUP))
    both = pages.unionByName(scripts_, allowMissingColumns=True)
    return both.select(*[
        (F.coalesce(f.name, F.array().cast(f.dataType)) if f.name in both.columns and f.name not in (*own, "lang") else F.col(f.name) if f.name in both.columns
         else F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in FILE_EXTRACT
    ])
