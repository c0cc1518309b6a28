"""Text normalisation and small scalar rules, as built-in column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_SCOPE = "global"

#: Unicode white space (property White_Space).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Trim Unicode white space, not only blanks."""
    return F.trim(col(c), F.lit(WHITE_SPACE))


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only: the folding a case-insensitive name match uses."""
    return F.translate(col(c), string.ascii_uppercase, string.ascii_lowercase)


def normalize_title(c: Column | str) -> Column:
    """Trim, lower-case and collapse white space."""
    return F.regexp_replace(F.lower(trim_space(c)), r"(?U)\s+", " ")


def normalize_content(c: Column | str) -> Column:
    """Trim, turn CRLF and CR into LF, keep at most one empty line in a row."""
    unix = F.replace(F.replace(trim_space(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(unix, r"\n{3,}", "\n\n")


def content_hash(c: Column | str) -> Column:
    """SHA-256 (hex) of the normalised content."""
    return F.sha2(normalize_content(c), 256)


def normalize_tags(c: Column | str) -> Column:
    """Lower, trim, drop empty tags and repeats, first occurrence order."""
    cleaned = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda t: F.lower(trim_space(t)))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


def normalize_scope(c: Column | str) -> Column:
    """Trim and lower-case; empty or missing means the global scope."""
    cleaned = F.lower(trim_space(c))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(DEFAULT_SCOPE))


def tags_to_json(c: Column | str) -> Column:
    return F.to_json(F.coalesce(col(c), F.array().cast("array<string>")))


def tags_from_json(c: Column | str) -> Column:
    """JSON list of strings; anything that does not parse is an empty list."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def round_score(c: Column | str) -> Column:
    """Three decimals, halves away from zero."""
    return F.round(col(c), 3)


def clamp(value: Column | str, low: int, high: int, default: int) -> Column:
    """``default`` for a missing or non-positive value, else the value inside [low, high]."""
    v = col(value)
    return F.when(v.isNull() | (v <= 0), F.lit(default)).otherwise(
        F.least(F.greatest(v, F.lit(low)), F.lit(high))
    )


def parse_rfc3339(c: Column | str) -> Column:
    """RFC 3339 text to timestamp; text that does not parse gives NULL."""
    text = col(c)
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text))


def format_rfc3339(c: Column | str) -> Column:
    """Timestamp to RFC 3339 text in UTC, whole seconds."""
    return F.date_format(F.to_utc_timestamp(col(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
