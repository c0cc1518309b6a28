"""Small helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import configure

#: Text bytes that one Python step works on, so that memory does not follow the batch.
SLICE_BYTES = 4 << 20


def session(spark: SparkSession) -> SparkSession:
    """The session with the runtime settings and Arrow batches of bounded size."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with the settings of this package."""
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as strings with 64-bit offsets; null becomes empty."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text of each is ``most`` bytes, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start, total = np.cumsum(sizes), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + most, side="right")))
            yield batch.slice(start, stop - start)
            total, start = int(ends[stop - 1]), stop


def strings(values: pa.Array) -> list[str]:
    """The values of a text array without nulls; by way of numpy, which is faster than to_pylist."""
    return values.cast(pa.string()).to_numpy(zero_copy_only=False).tolist()


def grouped_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups that end at ``ends``; empty groups give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(np.concatenate(([0], total[ends])))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one after another."""
    lengths = lengths.astype(np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


#: Bits of a bitmap that is sent to all tasks: a fixed 4 MB, whatever the input.
BITMAP_BITS = 1 << 25
#: Bits in one row of bitmap_construct_agg.
BITMAP_ROW = 32768


def bitmap(hashes: DataFrame, column: str = "hash") -> np.ndarray:
    """Bytes of a bitmap with bit ``hash mod BITMAP_BITS`` set for every hash.

    It only saves later work: a full bitmap lets everything pass, and an exact
    join follows wherever it is used.  Its size never depends on the input.
    """
    slot = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    rows = (
        hashes.where(F.col(column).isNotNull())
        .select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / BITMAP_ROW).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg((F.col("slot") % BITMAP_ROW).cast("long")).alias("bits"))
    )
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for part, bits in rows.toLocalIterator():
        at = part * BITMAP_ROW // 8
        out[at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit hashes may be in the bitmap."""
    slot = hashes & (8 * len(bits) - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
