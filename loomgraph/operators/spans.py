"""Smallest enclosing span of a position, without comparing all pairs of a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.lookup import contains_join
from loomgraph.operators.skew import salted_join

CALLER_KINDS = ("function", "method", "arrow_function")

#: Cell widths are powers of two with these exponents.  A span belongs to the
#: first width that is not smaller than itself, so it touches at most two cells.
LEVELS = (4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60)


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(point_id, span_id) of the shortest span around each point, ties by span id.

    ``points`` has keys, point_id, lo, hi; ``spans`` has keys, span_id, lo, hi.
    Bounds are inclusive and not negative.  Points without a span give no row.

    A span is stored in the one or two cells of its own size class, and a point
    looks into its cell of every size class in use.  A cell is at most sixteen
    times as wide as its spans, so a long file falls apart into many small
    joins instead of pairing all its points with all its spans.
    """
    keys = list(keys)
    length = F.col("s_hi") - F.col("s_lo") + 1
    level = F.lit(LEVELS[-1])
    for exponent in reversed(LEVELS[:-1]):
        level = F.when(length <= F.lit(1 << exponent), exponent).otherwise(level)
    cells = (
        spans.groupBy(*keys, F.col("lo").cast("long").alias("s_lo"), F.col("hi").cast("long").alias("s_hi"))
        .agg(F.min("span_id").alias("span_id"))
        .withColumn("level", level)
        .withColumn("cell", F.explode(F.expr("array_distinct(array(shiftright(s_lo, level), shiftright(s_hi, level)))")))
    )
    levels_in_use = cells.select("level").distinct()
    probes = (
        points.select(
            *keys, "point_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"),
            F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level"),
        )
        .join(F.broadcast(levels_in_use), "level", "left_semi")  # at most len(LEVELS) rows
        .withColumn("cell", F.expr("shiftright(lo, level)"))
    )
    return (
        salted_join(probes, cells, [*keys, "level", "cell"], spread_by=["point_id"])
        .where("s_lo <= lo AND s_hi >= hi")
        .groupBy("point_id")
        .agg(F.min(F.struct((F.col("s_hi") - F.col("s_lo")).alias("len"), F.col("span_id"))).alias("best"))
        .select("point_id", F.col("best.span_id").alias("span_id"))
    )


def attribute_callers(callsites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Fill ``caller`` of call sites that have none: smallest function around them."""
    spans = symbols.where(F.col("kind").isin(*CALLER_KINDS)).select(
        "file_id", F.col("id").alias("span_id"), F.col("start_byte").alias("lo"), F.col("end_byte").alias("hi")
    )
    points = callsites.where("caller IS NULL").select(
        "file_id", F.col("id").alias("point_id"), F.col("start_byte").alias("lo"), F.col("end_byte").alias("hi")
    )
    found = smallest_enclosing(points, spans, ["file_id"]).withColumnsRenamed({"point_id": "id", "span_id": "found"})
    return (
        callsites.join(found, "id", "left")
        .withColumn("caller", F.coalesce("caller", "found"))
        .select(*callsites.columns)
    )


def locate_symbols(locations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(loc_id, symbol_id): smallest symbol whose lines hold the location.

    ``locations`` has loc_id, repo_id, path, line (1-based).
    """
    spans = symbols.select(
        "file_id", F.col("id").alias("span_id"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi")
    )
    where = files.select(F.col("id").alias("file_id"), "repo_id", "path")
    points = salted_join(
        locations.select("repo_id", "path", F.col("loc_id").alias("point_id"),
                         F.col("line").alias("lo"), F.col("line").alias("hi")),
        where, ["repo_id", "path"],
    )
    return smallest_enclosing(points, spans, ["file_id"]).withColumnsRenamed(
        {"point_id": "loc_id", "span_id": "symbol_id"}
    )


def locate_or_match(locations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Like ``locate_symbols``; what it misses is matched by name.

    ``locations`` also has ``callee_text``: its last dot component is looked up
    with a contains-match and the smallest matching id is taken.  Returns
    (loc_id, symbol_id, how) with how = location or name.
    """
    by_place = locate_symbols(locations, symbols, files)
    missed = locations.join(by_place, "loc_id", "left_anti").select(
        "loc_id", "repo_id", F.substring_index("callee_text", ".", -1).alias("query")
    )
    first_ids = symbols.groupBy("repo_id", "name").agg(F.min("id").alias("id"))
    matches = (
        contains_join(missed, first_ids)
        .join(first_ids, ["repo_id", "name"])
        .groupBy("repo_id", "query")
        .agg(F.min("id").alias("symbol_id"))
    )
    by_name = salted_join(missed, matches, ["repo_id", "query"], spread_by=["loc_id"])
    return by_place.withColumn("how", F.lit("location")).unionByName(
        by_name.select("loc_id", "symbol_id", F.lit("name").alias("how"))
    )
