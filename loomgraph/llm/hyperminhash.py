"""Near-duplicate documents by compressed minimum hashes.

A document's set holds the hashes of its distinct shingles of three words.  Its
sketch has a register for each of REGISTERS buckets: of the smallest hash in the
bucket the number of leading zeros and the MANTISSA bits behind the first one.
An empty bucket takes the register of another, drawn by a fixed sequence of its
own, so that two sketches agree in a register with the probability of their
sets' similarity however small the sets are.

1. Equal sets meet under a 128-bit hash; one of each goes on.
2. Bands of ROWS registers are keys.  All sets of a band are put into one cell,
   that of the smallest set which any of them meets in a band, so that a set is in
   few cells.  Of two sets with a similarity of 0.85 a band agrees with probability
   0.85 ** 6 = 0.38, none of 32 with 3e-7.
3. The full sets of a cell are compared in one task, or, if it is large, in
   one task for every two of its chunks.  Pairs that links connect already are
   skipped; of the others the sketches give an estimate, corrected for registers
   that agree by chance; pairs within DEVIATIONS standard deviations of the
   threshold are confirmed on the sets.
4. Components of the confirmed links, joined with the documents by set.

Only texts of sets in cells are read again; full sets are not stored.

Results for odd input: a null text, or one without words, has an empty set, is
linked with nothing and its own component; fewer than three words are one
shingle; upper case is A-Z only, white space is ASCII's; rows that repeat are
documents of one component; a null doc_id is never the smallest, and a component
of only such has a null id; other columns, whatever their names, are not looked
at; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bitmap, in_bitmap, slices, strings, text_of
from loomgraph.llm.components import components
from loomgraph.session import materialize

WORDS = 3
#: Sets are linked if 100 * shared >= THRESHOLD * (in either).
THRESHOLD = 85
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: A register holds 6 bits of leading zeros and these.
MANTISSA = 10
DEVIATIONS = 5
#: Sets and shingles of a cell that are compared in one piece.
MOST = 4096
MOST_SHINGLES = 1 << 21
#: Bytes of text that are cut at a time.
SLICE = 1 << 20
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of some texts in ascending order, text after text, and where each text's begin (and end)."""
    split = pc.ascii_split_whitespace(texts)
    numbered = split.flatten().dictionary_encode()
    names = strings(numbered.dictionary)
    digest = xxhash.xxh64_intdigest
    code = numbered.indices.to_numpy(zero_copy_only=False)
    kept = np.array([bool(w) for w in names], dtype=bool)[code]  # white space at a border leaves an empty word
    # of bytes only A-Z are lowered
    hashes = np.array([digest(w.encode().lower()) for w in names], dtype=np.uint64)[code][kept]
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))[kept]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    sizes = np.diff(bounds)
    # a text with fewer words has one shingle, of those it has
    n = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    of = np.repeat(np.arange(len(texts)), n)
    begin = np.repeat(bounds[:-1], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(len(of), dtype=np.uint64)
    for i in range(words):
        inside = i < sizes[of]
        with np.errstate(over="ignore"):
            word = hashes[np.minimum(begin + i, len(hashes) - 1)] if len(hashes) else out
            out = np.where(inside, mixed(out * MIX_B + word + np.uint64(i + 1)), out)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        out[a:b].sort()
    fresh = np.concatenate(([True], (of[1:] != of[:-1]) | (out[1:] != out[:-1])))[: len(of)]
    out, of = out[fresh], of[fresh]
    return out, np.searchsorted(of, np.arange(len(texts) + 1))


@functools.cache
def detours() -> np.ndarray:
    """For every register (row) the place of every bucket in the order in which it would borrow from them."""
    draws = mixed(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS)
    return draws.argsort(axis=1).argsort(axis=1).astype(np.int16)


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sketches of some sets, REGISTERS unsigned 16-bit numbers each; of an empty set they mean nothing."""
    n = len(bounds) - 1
    spread = mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
    bucket = ((spread >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    slot = np.repeat(np.arange(n) * REGISTERS, np.diff(bounds)) + bucket
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, slot, mixed(spread ^ MIX_A))
    filled = np.zeros(n * REGISTERS, dtype=bool)
    filled[slot] = True
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(least, np.uint64(1)))).astype(np.int64), 0, 63 - MANTISSA)
    mantissa = (least >> (63 - MANTISSA - zeros).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16).reshape(n, REGISTERS)
    filled, order = filled.reshape(n, REGISTERS), detours()
    for row in np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1)).tolist():
        has = np.flatnonzero(filled[row])
        lacks = np.flatnonzero(~filled[row])
        out[row, lacks] = out[row, has[order[np.ix_(lacks, has)].argmin(axis=1)]]
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of two sets without common elements agrees, by their sizes."""
    a, b = (np.maximum(x / REGISTERS, 1.0) for x in (n, m))  # a borrowed register is that of a set of one
    both = a + b
    total = np.zeros(np.shape(both))
    for zeros in range(64 - MANTISSA):
        # minima between 2 ** -(zeros + 1) and 2 ** -zeros agree if they are in one of 2 ** MANTISSA equal cells
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        total += low / (1 << MANTISSA) * a * b / both * (np.exp(-both * low) - np.exp(-both * high))
    return total


def estimate(agreeing: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity by the number of registers that agree, less those that do by chance."""
    by_chance = chance(n, m)
    return (agreeing / REGISTERS - by_chance) / (1 - by_chance)


def slack(n: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """How far below the threshold the estimate of a linked pair may be; borrowed registers tell nothing new."""
    own = REGISTERS * (1 - np.exp(-n / REGISTERS))
    t = threshold / 100
    return DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(own, 1))


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, set, n_shingles, registers) of (doc_id, text, text_hash); ``set`` is a hash of the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            hashes, bounds = shingle_sets(text_of(batch), words)
            parts = [hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            sketch = registers(hashes, bounds).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array([_digest(p) if len(p) else None for p in parts], pa.binary()),
                    pa.array(np.diff(bounds)), pa.array([sketch[i].tobytes() if len(p) else None for i, p in enumerate(parts)], pa.binary()),
                ],
                names=["doc_id", "text_hash", "set", "n_shingles", "registers"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, set binary, n_shingles long, registers binary")


def cells(sets: DataFrame) -> DataFrame:
    """(cell, node) of the sets (node, registers) that share a band with another; all sets of a band are in one cell.

    The smallest set of a band is its head.  A band goes to the cell of the
    smallest head that any of its sets has, so that the bands of one group of near
    copies mostly lead to one cell.
    """
    width = 2 * ROWS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width)))
    )
    keyed = materialize(sets.select("node", F.explode(bands).alias("band")), "bands")
    heads = keyed.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "head")
    # stored, so that the joins are ones of two plain tables, whose hot bands Spark can split
    met = materialize(keyed.join(materialize(heads, "band-heads"), "band"), "shared-bands")
    low = met.groupBy("node").agg(F.min("head").alias("low"))
    lows = met.select("node", "band").join(low, "node").groupBy("band").agg(F.min("low").alias("cell"))
    return met.select("node", "band").join(materialize(lows, "band-cells"), "band").select("cell", "node").distinct()


def confirmed(nodes: np.ndarray, sketch: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, side: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is confirmed as similar among some sets of one cell: of every set to the first it is connected with.

    ``side`` is -1 where all sets are compared, else only those of different sides are.
    """
    n = np.diff(bounds)
    label, left_apart = np.arange(len(nodes)), len(nodes)
    parent = label.copy()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for shift in range(1, len(nodes)):
        left = np.flatnonzero(label[:-shift] != label[shift:])
        right = left + shift
        small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
        # sets of too different sizes can't be similar enough
        near = ((side[left] < 0) | (side[left] != side[right])) & (100 * small >= threshold * large)
        left, right, small, large = left[near], right[near], small[near], large[near]
        agreeing = np.zeros(len(left), dtype=np.int64)
        for at in range(0, len(left), 1024):
            agreeing[at : at + 1024] = (sketch[left[at : at + 1024]] == sketch[right[at : at + 1024]]).sum(axis=1)
        near = estimate(agreeing, small, large) >= threshold / 100 - slack(small, threshold)
        for a, b in zip(left[near].tolist(), right[near].tolist()):
            u, v = root(a), root(b)
            if u == v:
                continue
            shared = len(np.intersect1d(hashes[bounds[a] : bounds[a + 1]], hashes[bounds[b] : bounds[b + 1]], assume_unique=True))
            if 100 * shared >= threshold * (n[a] + n[b] - shared):
                parent[max(u, v)] = min(u, v)
                left_apart -= 1
        label = parent
        while not np.array_equal(label, label[label]):
            label = label[label]
        parent = label.copy()
        if left_apart == 1:
            break
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def _confirm(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        cells = group.column("cell").to_numpy()
        order = np.lexsort((group.column("node").to_numpy(), cells))
        starts = np.flatnonzero(np.concatenate(([True], np.diff(cells[order]) != 0)))
        out: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            part = group.take(pa.array(order[a:b]))
            sets = [np.frombuffer(x, dtype="<u8") for x in part.column("hashes").to_pylist()]
            sketch = np.stack([np.frombuffer(x, dtype="<u2") for x in part.column("registers").to_pylist()])
            src, dst = confirmed(part.column("node").to_numpy(), sketch, np.concatenate(sets), np.cumsum([0, *map(len, sets)]), part.column("side").to_numpy(), threshold)
            out[0].append(src)
            out[1].append(dst)
        return pa.table({"src": np.concatenate(out[0]), "dst": np.concatenate(out[1])})

    return run


def links(rows: DataFrame, sets: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Confirmed links (src, dst) of the sets (node, n_shingles, registers, doc_id, text_hash: of a document that has it)."""
    placed = materialize(sets.join(cells(sets), "node"), "placed-sets")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("sets") / MOST), F.ceil(F.col("shingles") / MOST_SHINGLES)).cast("int")
    sizes = materialize(sizes.select("cell", "shingles", chunks.alias("chunks")), "cell-sizes")
    large = sizes.where("chunks > 1").select("cell", "chunks")
    total = sizes.agg(F.sum(F.col("shingles") * F.col("chunks"))).first()[0] or 0
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(placed.select(F.xxhash64("doc_id", "text_hash").alias("hash"))))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bits.value, batch.column("key").to_numpy())))
            for part in slices(iter([batch]), most=SLICE):
                hashes, bounds = shingle_sets(text_of(part), words)
                sets = [hashes[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(sets, pa.binary())], names=["of", "of_text", "hashes"])

    read = rows.withColumn("key", F.xxhash64("doc_id", "text_hash")).mapInArrow(full, f"of {kind}, of_text long, hashes binary").dropDuplicates(["of", "of_text"])
    on = placed["doc_id"].eqNullSafe(read["of"]) & placed["text_hash"].eqNullSafe(read["of_text"])
    whole = placed.join(read, on).join(large, "cell", "left").select("cell", "chunks", "node", "registers", "hashes")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j")),
    )
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    whole = whole.withColumn("own", own).withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), one).otherwise(pairs)))
    whole = whole.select(
        F.xxhash64("cell", "pair.i", "pair.j").alias("cell"), "node", "registers", "hashes",
        F.when(F.col("pair.i") == F.col("pair.j"), F.lit(-1)).otherwise(F.col("own")).alias("side"),
    )
    groups = max(1, -(-4 * total // MOST_SHINGLES))
    return whole.groupBy(F.pmod("cell", F.lit(groups)).alias("group")).applyInArrow(_confirm(threshold), "src long, dst long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept)."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash"))
    found = materialize(sketches(rows, words), "sketches")
    filled = found.where(F.col("set").isNotNull())
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    distinct = filled.groupBy("set").agg(F.min("doc_id").alias("least"), one, F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    distinct = materialize(
        distinct.select("set", "least", F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash"), "n_shingles", "registers")
        .withColumn("node", F.monotonically_increasing_id()),
        "distinct-sets",
    )
    joined = links(rows, distinct.select("node", "n_shingles", "registers", "doc_id", "text_hash"), words, threshold)
    roots = materialize(components(joined, "similar"), "roots")
    placed = distinct.select("set", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.select("set", "root").join(heads, "root").select(F.col("set").alias("of_set"), "component")
    whole = found.join(named, found["set"] == named["of_set"], "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
