"""Sequences of bounded length from whole documents by sum-of-squares packing.

A document goes where the sum over all residual gaps of the squared number of
open sequences with that gap becomes smallest; taking a sequence of gap g for s
tokens changes that sum by 2 * (N(g - s) - N(g) + 1), where full sequences do
not count, and a new one by 2 * N(capacity - s) + 1.  Shards of a bounded number
of pieces are packed side by side, longest first.  The sequences that a shard
could not fill are then packed again as pieces of their own, in far fewer
shards, a fixed number of times; a few that could still be merged may stay.

Results for odd input: a null or empty text is a document of one token (its end
id); rows that repeat are packed each; null ids stay null; an empty table gives
an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import slices, text_of
from loomgraph.llm.tokens import END_ID, WORD_BPE, encode_documents
from loomgraph.session import materialize

CAPACITY = 4096
#: Pieces that one task packs.
SHARD = 20_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (doc_id, piece, start, length, ids_crc32)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, ends = encode_documents(text_of(batch), tokenizer, end_id)
            ids = ids.astype("<u4")
            lengths = np.diff(np.concatenate(([0], ends)))
            counts = -(-lengths // capacity)
            row = np.repeat(np.arange(len(ends)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            size = np.minimum(capacity, lengths[row] - start)
            at = (ends - lengths)[row] + start
            crc = np.fromiter((zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), size.tolist())), dtype=np.int64, count=len(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every size, in the order given, by the sum-of-squares rule.

    Among equal changes of the sum the smallest gap wins, so the fullest
    sequence is taken; of sequences with equal gaps the one opened last.
    """
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by gap
    count = np.zeros(capacity + 1, dtype=np.int64)
    filled: list[int] = []
    sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    never = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        have = count[size:]
        change = np.where(have > 0, 2 * (count[: capacity + 1 - size] - have + 1), never)
        if count[size]:
            change[0] = 1 - 2 * count[size]  # a filled sequence no longer counts
        best = int(change.argmin())
        if change[best] <= 2 * count[capacity - size] + 1:
            gap = best + size
            number = open_with[gap].pop()
            count[gap] -= 1
        else:
            gap, number = capacity, len(filled)
            filled.append(0)
        sequence[i], offset[i] = number, filled[number]
        filled[number] += size
        if gap > size:
            open_with[gap - size].append(number)
            count[gap - size] += 1
    return sequence, offset


def _pack(rows: DataFrame, n_rows: int, columns: str, capacity: int, shard: int) -> DataFrame:
    """Rows with a ``length`` below the capacity, packed shard by shard: plus (sequence, offset).

    ``rows`` is a stored table, so that the row numbers that spread it over the
    shards are the same whenever a task runs again.
    """
    shards = max(1, -(-n_rows // shard))
    spread_out = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending")])
        sequence, offset = place(group.column("length").to_numpy(), capacity)
        sequence += group.column("shard")[0].as_py() << 32
        return group.append_column("sequence", pa.array(sequence)).append_column("offset", pa.array(offset)).drop_columns("shard")

    return spread_out.groupBy("shard").applyInArrow(run, f"{columns}, sequence long, offset long")


def pack(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, rounds: int = 2) -> DataFrame:
    """Add (sequence_id, offset) to pieces with a ``length`` of at most ``capacity``.

    Pieces of the full capacity are sequences of their own.  After the first
    round, ``rounds`` more pack the sequences that are not full as single pieces.
    """
    parts = materialize(parts, "pieces")
    whole = parts.where(F.col("length") >= capacity).select(
        *parts.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    short = parts.where(F.col("length") < capacity)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    packed = materialize(_pack(short, short.count(), columns, capacity, shard), "packed")
    moves = packed.groupBy("sequence").agg(F.sum("length").alias("length")).withColumnsRenamed({"sequence": "was"})
    moves = moves.withColumn("target", F.col("was")).withColumn("base", F.lit(0).cast("long"))
    # moves: was -> target, base: where each first-round sequence has gone
    for _ in range(rounds):
        moves = materialize(moves, "moves")
        sums = moves.groupBy("target").agg(F.sum("length").alias("length")).where(F.col("length") < capacity)
        sums = materialize(sums, "unfilled")
        again = materialize(_pack(sums, sums.count(), "target long, length long", capacity, shard), "packed-again")
        heads = again.where("offset = 0").select("sequence", F.col("target").alias("head"))
        again = again.join(heads, "sequence").select("target", "head", "offset")
        moves = moves.join(again, "target", "left").select(
            "was", "length", F.coalesce("head", "target").alias("target"), (F.col("base") + F.coalesce("offset", F.lit(0))).alias("base"),
        )
    placed = packed.join(moves.select(F.col("was").alias("sequence"), "target", "base"), "sequence")
    return whole.union(placed.select(*parts.columns, F.col("target").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """All documents in sequences of ``capacity`` tokens: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(pieces(docs, capacity, tokenizer, end_id), capacity)
