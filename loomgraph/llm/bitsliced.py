"""Exact top-k inner products from a bit-sliced index.

The index holds blocks of vectors.  Of every component, less its minimum in the
block, each binary digit is a bitmap over the rows (a slice).  For a query the
slices are added with the query's components as weights by bitmap arithmetic:
three bitmaps of one weight become their sum (exclusive or) and their carry
(majority) of the next weight, until one bitmap per weight is left: the slices
of all scores.  A negative weight adds the complement of its slices.  The top k
rows are then chosen from the most significant slice downward; rows still equal
after the last one are taken in the order of their ids, which is the order of
the bits.  Scores are read from the slices of the chosen rows.

Every query meets every block once; only k rows per query and block leave a task.

Results for odd input: vectors that are null or hold null or non-finite
components, and rows without an id, take no part; vectors are compared with those
of their own length only; rows with the id of the query are its own; equal
scores go to the smaller id; a repeated query row is one query; an empty table
gives an empty table.  Scores are longs; vectors so large that they do not fit
wrap around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize

SCALE = 256
#: Bits of all slices of one component over a block; longer vectors get smaller blocks.
BLOCK_ROWS = 65536
BLOCK_DIMS = 64
#: Queries that one task compares with one block.
CHUNK = 128
#: Words of 64 rows that are added at a time, so that the bitmaps of one weight stay in the cache.
STRIP = 1024


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dims, q): every component x as floor(scale * x)."""
    good = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & good)
    q = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(column).alias("dims"), q.alias("q"))


def build(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The index of quantised vectors, one row per block, and the number of blocks.

    ``vectors`` is a stored table; its row numbers spread equal ids over the blocks.
    """
    n, dims = vectors.agg(F.count(F.lit(1)), F.max("dims")).first()
    rows = max(64, BLOCK_ROWS * BLOCK_DIMS // max(BLOCK_DIMS, dims or 1))
    blocks = max(1, -(-n // rows))
    spread = vectors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        dims, block = group.column("dims")[0].as_py(), group.column("block")[0].as_py()
        values = group.column("q").combine_chunks().flatten().to_numpy().reshape(len(group), dims)
        low = values.min(axis=0) if dims else np.zeros(0, dtype=np.int64)
        shifted = (values - low).view(np.uint64)
        bits = max(1, int(shifted.max()).bit_length()) if dims else 1
        words = -(-len(group) // 64)
        slices = np.zeros((dims, bits, words * 8), dtype=np.uint8)
        for b in range(bits):
            packed = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
            slices[:, b, : len(packed)] = packed.T
        return pa.table({
            "dims": pa.array([dims], pa.int32()), "block": pa.array([block], pa.int32()), "bits": pa.array([bits], pa.int32()),
            "ids": pa.array([group.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "low": pa.array([low.astype("<i8").tobytes()], pa.binary()), "slices": pa.array([slices.tobytes()], pa.binary()),
        })

    return spread.groupBy("dims", "block").applyInArrow(run, "dims int, block int, bits int, ids binary, low binary, slices binary"), blocks


def score_slices(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices of the scores (up to a constant), least significant first.

    ``slices`` is (2, dims, bits, words): the slices and their complements.
    """
    _, dims, bits, words = slices.shape
    flat = slices.reshape(2 * dims * bits, words)
    size = np.abs(query).view(np.uint64)
    digits = int(size.max()).bit_length() if dims else 0
    used, digit = np.nonzero((size[:, None] >> np.arange(digits, dtype=np.uint64)) & np.uint64(1))
    row = (((query[used] < 0) * dims + used) * bits)[:, None] + np.arange(bits)
    weight = digit[:, None] + np.arange(bits)
    order = np.argsort(weight, axis=None, kind="stable")
    row, bounds = row.ravel()[order], np.searchsorted(weight.ravel()[order], np.arange(digits + bits + 1))
    out: list[np.ndarray] = []
    carries: list[np.ndarray] = []
    while len(out) < digits + bits - 1 or carries:
        w = len(out)
        own = [flat[row[bounds[w] : bounds[w + 1]]]] if w < digits + bits - 1 else []
        rows = np.concatenate([*own, *carries])
        carries = []
        while len(rows) > 1:
            n = len(rows) // 3
            if n:
                a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                ab = a ^ b
                carry = ab & c
                carry |= a & b
                ab ^= c
                rows = np.concatenate((ab, rows[3 * n :])) if len(rows) > 3 * n else ab
            else:
                carry = rows[:1] & rows[1:]
                rows = rows[:1] ^ rows[1:]
            carries.append(carry)
        out.append(rows[0] if len(rows) else np.zeros(words, dtype=np.uint64))
    return out


def ones(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(sums: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums among ``allowed``, by the slices from the most significant down; ties to the lowest rows."""
    chosen, equal = np.zeros_like(allowed), allowed
    for part in reversed(sums):
        higher = equal & part
        n = ones(chosen) + ones(higher)
        if n > k:
            equal = higher
        elif n < k:
            chosen, equal = chosen | higher, equal & ~part
        else:
            chosen, equal = chosen | higher, np.zeros_like(equal)
            break
    rows = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
    # the boundary: rows with exactly the same sum, in the order of their ids
    rest = np.flatnonzero(np.unpackbits(equal.view(np.uint8), bitorder="little"))[: k - len(rows)]
    return np.concatenate((rows, rest))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _search_block({c: batch.column(c)[row].as_py() for c in batch.schema.names if c != "queries"}, batch.column("queries")[row].as_py(), k)

    return run


def _search_block(index: dict, queries: list[dict], k: int) -> pa.RecordBatch:
    """The best k rows of one block for every query."""
    ids, low = np.frombuffer(index["ids"], dtype="<i8"), np.frombuffer(index["low"], dtype="<i8")
    dims, bits, words = index["dims"], index["bits"], -(-len(ids) // 64)
    plain = np.frombuffer(index["slices"], dtype=np.uint64).reshape(dims, bits, words)
    slices = np.stack((plain, ~plain))
    everything = np.zeros(words * 64, dtype=np.uint8)
    everything[: len(ids)] = 1
    found: tuple[list, list, list] = ([], [], [])
    full = (1 << bits) - 1
    for query in queries:
        q = np.array(query["q"], dtype=np.int64)
        own = everything.copy()
        a, b = np.searchsorted(ids, query["vec_id"], "left"), np.searchsorted(ids, query["vec_id"], "right")
        own[a:b] = 0
        strips = [score_slices(slices[..., a : a + STRIP], q) for a in range(0, words, STRIP)]
        sums = [np.concatenate(parts) for parts in zip(*strips)]
        rows = top_rows(sums, np.packbits(own, bitorder="little").view(np.uint64), k)
        # what the minima and the complements have taken away
        offset = sum(int(w) * (int(m) if w > 0 else int(m) + full) for w, m in zip(q.tolist(), low.tolist()))
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        digits = [((part[word] >> bit) & np.uint64(1)).tolist() for part in sums]
        for i, r in enumerate(rows.tolist()):
            score = offset + sum(d[i] << w for w, d in enumerate(digits))
            found[0].append(query["vec_id"])
            found[1].append(int(ids[r]))
            found[2].append((score + (1 << 63)) % (1 << 64) - (1 << 63))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row where ``is_query`` (of vec_id) holds."""
    stored = materialize(quantised(vectors, column), "quantised")
    index, blocks = build(stored)
    index = materialize(index, "bit-sliced-index")
    queries = materialize(stored.where(is_query).dropDuplicates(["vec_id", "dims", "q"]), "queries")
    chunks = max(1, -(-queries.count() // CHUNK))
    numbered = queries.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
    # each chunk is bounded; it is compared with every block, in a task of its own
    lists = numbered.groupBy("dims", "chunk").agg(F.collect_list(F.struct("vec_id", "q")).alias("queries"))
    asked = lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    pairs = held.join(asked, ["dims", "block", "chunk"])
    found = pairs.select("dims", "bits", "ids", "low", "slices", "queries").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
