"""Joins and rankings that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import MOST_PARTITIONS, materialize

#: A key with more rows than this on the split side is spread over SALTS tasks.
HOT_ROWS = 1_000_000
SALTS = 64
#: At most this many keys are treated as hot, so the list has a fixed size bound
#: and may be broadcast.  Keys beyond it are still joined, only not spread.
HOT_KEYS = 10_000
#: A side the planner knows to be smaller than this fits one task even if all
#: its rows share a key; its keys are not counted.
SMALL_BYTES = 64 * 1024 * 1024
#: About so many pairs are made by one task of ``spread_pairs``.
TASK_PAIRS = 1_000_000


def planned_bytes(df: DataFrame) -> int:
    """Size of a DataFrame as the optimizer estimates it (file sizes for stored tables)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_broadcast(df: DataFrame) -> bool:
    """Whether the planner sends the frame whole to the tasks that join it, so that no key of the other side is dealt out."""
    return planned_bytes(df) <= int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """The heaviest keys of ``df``: (on..., __hot), at most HOT_KEYS rows."""
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__rows") > (HOT_ROWS if hot_rows is None else hot_rows))
        .orderBy(F.desc("__rows"))
        .limit(HOT_KEYS)
        .select(*on, F.lit(True).alias("__hot"))
    )


def salted_join(
    heavy: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    hot_rows: int | None = None,
    salts: int = SALTS,
    hot: DataFrame | None = None,
    small_bytes: int | None = None,
) -> DataFrame:
    """Equi-join whose hot keys on the ``heavy`` side are split over ``salts`` tasks.

    Rows of a hot key are spread by a hash of ``spread_by`` (all columns by
    default), never by a random number, so that a re-run task writes the same
    rows; the matching rows of ``other`` are repeated once per salt.  Keys that
    are not hot carry salt 0 and are joined as usual.  ``how`` is inner, left,
    left_semi or left_anti (heavy on the left).
    """
    on = list(on)
    if planned_bytes(heavy) < (SMALL_BYTES if small_bytes is None else small_bytes):
        return heavy.join(other, on, how)
    spread_cols = list(spread_by or heavy.columns)
    # Counting reads ``heavy`` a second time: pass a stored table, a projection
    # of one, or ready-made ``hot`` keys.
    if hot is None:
        hot = hot_keys(heavy.select(*on), on, hot_rows)
    left = (
        heavy.join(F.broadcast(hot), on, "left")
        .withColumn(
            "__salt",
            F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread_cols), F.lit(salts)).cast("int")).otherwise(0),
        )
        .drop("__hot")
    )
    right = (
        other.join(F.broadcast(hot), on, "left")
        .withColumn(
            "__salt",
            F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("__hot")
    )
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def spread_join(
    heavy: DataFrame, light: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", salts: int = 16,
) -> DataFrame:
    """Equi-join that splits every key over ``salts`` tasks without counting first.

    For a ``light`` side that is cheap to repeat ``salts`` times.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    left = heavy.withColumn("__salt", salt)
    right = light.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def spread_pairs(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str], task_pairs: int | None = None,
) -> DataFrame:
    """Inner equi-join whose tasks are bounded by the pairs they make, not by the bytes they read.

    Few keys with many rows on both sides are small as tables, so that one task
    would get them all, and make far more pairs than rows.  The pairs of every key are
    counted first; a key with more than ``task_pairs`` is cut into cells, the left side by
    a hash of ``spread_by``, the right one by a hash of its other columns.  Cells have about as
    many rows of either side, so that a row is repeated as often as the root of the
    number of cells.  Both sides are read twice: pass stored tables or projections of them.
    """
    on, most = list(on), TASK_PAIRS if task_pairs is None else task_pairs
    rows = F.count(F.lit(1))
    counts = left.groupBy(*on).agg(rows.alias("n")).join(right.groupBy(*on).agg(rows.cast("double").alias("m")), on, "left")
    # a key without a partner makes no pair, but is read
    weighed = materialize(counts.select(*on, "n", "m", F.greatest(F.col("n") * F.col("m"), F.col("n").cast("double")).alias("pairs")), "pair-counts")
    pairs = weighed.agg(F.sum("pairs")).first()[0] or 0
    if pairs <= most:
        return left.join(right, on)
    tasks = min(int(pairs // most) + 1, MOST_PARTITIONS)
    cells = F.ceil(F.col("pairs") / most)
    down = F.least(cells, F.ceil(F.sqrt(cells * F.col("n") / F.coalesce("m", F.lit(1.0)))))
    hot = weighed.where(F.col("pairs") > most).orderBy(F.desc("pairs")).limit(HOT_KEYS).select(
        *on, down.cast("int").alias("__down"), F.ceil(cells / down).cast("int").alias("__across")
    )

    def split(by: Sequence[str], parts: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.coalesce(parts, F.lit(1))).cast("int")

    def repeated(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))

    def dealt(side: DataFrame, row: Column, column: Column) -> DataFrame:
        cell = side.join(F.broadcast(hot), on, "left").withColumn("__row", row).withColumn("__column", column)
        return cell.drop("__down", "__across").repartition(tasks, *on, "__row", "__column")

    others = [c for c in right.columns if c not in on]
    rows_of, columns_of = dealt(left, split(spread_by, "__down"), repeated("__across")), dealt(right, repeated("__down"), split(others, "__across"))
    return rows_of.join(columns_of, [*on, "__row", "__column"]).drop("__row", "__column")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, ties: bool = False
) -> DataFrame:
    """First ``limit`` rows of every key, or first ``limit`` distinct ranks with ``ties``.

    The rank is compared with a literal, which lets Spark cut each map task's
    rows to ``limit`` per key before the shuffle; a hot key therefore sends at
    most ``limit`` rows per task, up to the group-limit threshold of the session
    settings (a million).
    """
    number = F.dense_rank() if ties else F.row_number()
    rank = number.over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")
