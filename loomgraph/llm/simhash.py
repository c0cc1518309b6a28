"""Near-duplicate documents from 64-bit similarity hashes met at anchors of a covering code.

Two fingerprints that differ in at most 4 bits differ in at most one bit in one
of three segments (22, 21 and 21 bits).  The anchors of a segment are the words
of a linear code: the perfect (15, 11) code on its first 15 bits, all values on
the rest, so that every value has an anchor within one bit.  A fingerprint goes
to all anchors within 1 + 1 bits of its segment; of two linked fingerprints each
thus reaches the nearest anchor of the other, where they are compared in full.
An anchor yields a spanning forest of its links, never all pairs; an anchor with
more than ``MOST`` fingerprints is compared chunk by chunk in separate tasks.

Results for odd input: a null text is an empty text, whose fingerprint is zero;
rows that repeat are documents of one component; null ids stay null and are
never the smallest; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import slices
from loomgraph.llm.components import components
from loomgraph.session import materialize

WORDS = 4
SEED = 42
THRESHOLD = 4
#: (first bit, bits) of the segments; with three of them one has at most THRESHOLD // 3 differing bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
NEAR = THRESHOLD // len(SEGMENTS)
RADIUS = 1
CODE_BITS = 15
#: Fingerprints of one anchor that are compared in one piece.
MOST = 4096
#: Rows of a group of anchors that one call compares.
GROUP_ROWS = 8192
#: Shingles hashed at a time.
STEP = 65536


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit-wise majority of the shingle hashes of a text (unsigned 64 bits)."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], gaps + 1))[:n]
    ends = np.concatenate((gaps, [len(joined)]))[-n:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        spans = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document and its ``fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = [fingerprint(t or "") for t in batch.column("__text").to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=[*keep, "fp"])

    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, fp long")


@functools.cache
def error_patterns(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flips of at most RADIUS + NEAR bits by syndrome: (masks, first mask, number of masks of each syndrome).

    The syndrome of a segment is the exclusive or of the positions (from 1) of
    the set bits among its first CODE_BITS; words of the code have syndrome 0.
    """
    groups: dict[int, list[int]] = {s: [] for s in range(CODE_BITS + 1)}
    for size in range(RADIUS + NEAR + 1):
        for flipped in itertools.combinations(range(bits), size):
            syndrome = functools.reduce(lambda s, b: s ^ (b + 1 if b < CODE_BITS else 0), flipped, 0)
            groups[syndrome].append(sum(1 << b for b in flipped))
    counts = np.array([len(groups[s]) for s in groups])
    return np.array(list(itertools.chain(*groups.values())), dtype=np.int64), np.cumsum(counts) - counts, counts


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, whether the anchor is a nearest one) for fingerprints as signed longs."""
    out = []
    for number, (first, bits) in enumerate(SEGMENTS):
        part = (fps >> first) & ((1 << bits) - 1)
        syndrome = np.zeros(len(part), dtype=np.int64)
        for bit in range(CODE_BITS):
            syndrome ^= np.where((part >> bit) & 1 == 1, bit + 1, 0)
        masks, starts, counts = error_patterns(bits)
        sizes = counts[syndrome]
        row = np.repeat(np.arange(len(part)), sizes)
        which = starts[syndrome][row] + np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        flips = masks[which]
        out.append(((number << 32) | (part[row] ^ flips), row, np.bitwise_count(flips) <= RADIUS))
    return tuple(np.concatenate(x) for x in zip(*out))


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            fps = batch.column("fp").slice(at, STEP).to_numpy()
            anchor, row, home = anchors_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row]), pa.array(home)], names=["anchor", "fp", "home"])


def forest(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, side: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what is within ``threshold`` bits under equal keys, at most one per fingerprint.

    ``side`` is -1 where all rows of a key are compared, else only rows of different sides are.
    """
    order = np.argsort(keys, kind="stable")
    keys, fps, home, side = keys[order], fps[order], home[order], side[order]
    nodes, at = np.unique(fps, return_inverse=True)
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    label = parent.copy()
    left = np.arange(len(keys))
    shift = 1
    while len(left):
        left = left[left + shift < len(keys)]
        left = left[keys[left] == keys[left + shift]]
        right = left + shift
        near = np.bitwise_count((fps[left] ^ fps[right]).view(np.uint64)) <= threshold  # of signed numbers it counts the absolute value
        near &= (home[left] | home[right]) & ((side[left] < 0) | (side[left] != side[right]))
        near &= label[at[left]] != label[at[right]]
        if near.any():
            for a, b in zip(at[left[near]].tolist(), at[right[near]].tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            label = parent
            while not np.array_equal(label, label[label]):
                label = label[label]
            parent = label.copy()
        shift += 1
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def _compare(group: pa.Table) -> pa.Table:
    keys = pc.cast(group.column("cell"), pa.int64()).to_numpy()
    a, b = forest(keys, group.column("fp").to_numpy(), group.column("home").to_numpy(), group.column("side").to_numpy())
    return pa.table({"src": a, "dst": b})


def links(fps: DataFrame, n_fps: int, most: int = MOST) -> DataFrame:
    """Spanning links (src, dst) of distinct fingerprints (fp) within THRESHOLD bits."""
    anchored = fps.select("fp").mapInArrow(_to_anchors, "anchor long, fp long, home boolean")
    sizes = anchored.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = materialize(sizes.select("anchor", F.ceil(F.col("n") / most).cast("int").alias("chunks")), "hot-anchors")
    rows = anchored.join(hot, "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j")),
    )
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = rows.withColumn("own", own).withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), one).otherwise(pairs)))
    groups = max(1, -(-n_fps * 48 // GROUP_ROWS))
    rows = rows.select(
        F.xxhash64("anchor", "pair.i", "pair.j").alias("cell"), "fp", "home",
        F.when(F.col("pair.i") == F.col("pair.j"), F.lit(-1)).otherwise(F.col("own")).alias("side"),
    )
    return rows.groupBy(F.pmod("cell", F.lit(groups)).alias("group")).applyInArrow(_compare, "src long, dst long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, text_hash, fp, component_id, keep).

    ``component_id`` is the smallest doc_id that links lead to.  ``keep`` marks
    the one document of a component that stays: the smallest (doc_id, text_hash).
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash"))
    found = materialize(fingerprints(rows, keep=("doc_id", "text_hash")), "fingerprints")
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("least")), "distinct-fingerprints")
    roots = materialize(components(links(distinct, distinct.count()), "similar"), "roots")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.min("least").alias("least"))
    named = placed.select("fp", "root").join(heads, "root").drop("root")
    whole = found.join(named, "fp")
    keep = F.struct("doc_id", "text_hash").eqNullSafe(F.col("least"))
    return whole.select("doc_id", "text_hash", "fp", "component_id", keep.alias("keep"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component; of equal (doc_id, text) rows one stays."""
    kept = near_duplicates(docs).where("keep").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    on = docs["doc_id"].eqNullSafe(kept["__id"]) & hashed["__hash"].eqNullSafe(kept["__hash"])
    return hashed.join(kept, on, "left_semi").dropDuplicates(["doc_id", "__hash"]).select(*docs.columns)
