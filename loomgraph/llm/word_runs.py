"""Removal of repeated runs of words, wherever in a line they begin and end.

Words are what white space (ASCII) separates.  A stretch of WORDS words is a
window; one that stood before (by doc_id, text hash, place) is repeated, and all
words in repeated windows are deleted.  That is every match of WORDS words or
more at its full length: each of its windows is repeated, its neighbours' are not.

1. Winnowing: the smallest hash of the SEED-word stretches in a window is its
   fingerprint.  Stretches that are a fingerprint at one place only are dropped;
   what is left of them is a bitmap of fixed size.
2. Long matches: stretches of WORDS + SEED words that begin at a fingerprint meet
   under their content; the first of each is kept by a partial aggregate, so no
   pairs within a group are made.  The windows inside a later one are repeated.
   They are left out of what follows: the first place of a window is never inside
   a later stretch, or the stretch's own first place would hold an earlier one.
   Places that are not later are a bitmap; one outside it is later for certain.
3. Borders: steps 1 and 2 again with the windows left, at every word.
4. The union of later stretches and windows is deleted with the white space
   behind its words.

Results for odd input: a null text stays null; rows with equal (doc_id, text) are
one document and get the same result; a null doc_id sorts first; a later window
is repeated even if it overlaps the first, so of a text that repeats one period
the first period stays; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bitmap, in_bitmap, slices, strings, text_of
from loomgraph.llm.line_dedup import BASE, SLICE, SPACES, UNBASE, cuts
from loomgraph.session import materialize

WORDS = 50
#: A window of WORDS words holds WORDS - SEED + 1 stretches of SEED words.
SEED = 25


#: A random number for each byte, the same in every run.
LETTERS = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i])) for i in range(256)), dtype=np.uint64)


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the values from every start to its end, the same wherever they stand: a polynomial modulo 2^64, mixed."""
    with np.errstate(over="ignore"):
        up, down = (np.full(len(values) + 1, b, dtype=np.uint64) for b in (BASE, UNBASE))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        sums = np.concatenate(([np.uint64(0)], np.add.accumulate(up[:-1] * values)))
        out = (sums[ends] - sums[starts]) * down[starts]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of every word of an array with 64-bit offsets, made of its bytes and their number."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    with np.errstate(over="ignore"):
        return stretches(LETTERS[raw], offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64) * np.uint64(BASE)


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all words of some texts, in order."""
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    kept = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at a border leaves an empty word
    return word_hashes(flat)[kept], text[kept]


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row, the same wherever they stand."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up, down = (np.full(n, b, dtype=np.uint64) for b in (BASE, UNBASE))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        up *= hashes
        sums = np.concatenate(([np.uint64(0)], np.add.accumulate(up)))
        out = (sums[size:] - sums[:-size]) * down[: n - size + 1]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def sliding(values: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``span`` values in a row."""
    n = len(values) - span + 1
    if n <= 0:
        return values[:0]
    step = 1
    while 2 * step <= span:
        values = best(values[:-step], values[step:])
        step *= 2
    return best(values[:n], values[span - step : span - step + n])


def windows(hashes: np.ndarray, texts: np.ndarray, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the stretch at every place, fingerprint of the window at every place, places where a window is)."""
    seeds = grams(hashes, seed)
    fingerprint = sliding(seeds, words - seed + 1, np.minimum)
    at = np.flatnonzero(texts[: len(fingerprint)] == texts[words - 1 :][: len(fingerprint)])
    return seeds, fingerprint, at


def places(seeds: np.ndarray, fingerprint: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Where the stretches begin that are the fingerprint of some window in ``at``."""
    # a place is a fingerprint's if the largest fingerprint of the windows around it is its own hash
    around = np.zeros(len(seeds) + span - 1, dtype=np.uint64)
    around[at + span - 1] = fingerprint[at]
    return np.flatnonzero(sliding(around, span, np.maximum) == seeds)


class Slice:
    """The windows of some texts, and those of them whose fingerprints may be repeated."""

    def __init__(self, batch: pa.RecordBatch, words: int, seed: int, repeated: np.ndarray | None = None) -> None:
        self.batch, self.words, self.seed = batch, words, seed
        self.hashes, self.texts = hashes_of(text_of(batch))
        self.seeds, self.fingerprint, self.at = windows(self.hashes, self.texts, words, seed)
        self.keep(repeated)

    def keep(self, repeated: np.ndarray | None) -> None:
        if repeated is not None:
            self.at = self.at[in_bitmap(repeated, self.fingerprint[self.at].view(np.int64))]

    def marks(self) -> pa.RecordBatch:
        """The fingerprints of the windows and the number of their places."""
        value, times = np.unique(self.seeds[places(self.seeds, self.fingerprint, self.at, self.words - self.seed + 1)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], names=["hash", "n"])

    def long(self) -> np.ndarray:
        """Where long stretches begin: at fingerprints that begin one of the windows."""
        at = np.intersect1d(places(self.seeds, self.fingerprint, self.at, self.words - self.seed + 1), self.at, assume_unique=True)
        at = at[at + self.words + self.seed <= len(self.texts)]
        return at[self.texts[at] == self.texts[at + self.words + self.seed - 1]]

    def spots(self, at: np.ndarray) -> np.ndarray:
        """A hash of document and place."""
        key = self.batch.column("key").to_numpy().view(np.uint64)[self.texts[at]]
        with np.errstate(over="ignore"):
            out = (key + (at - np.searchsorted(self.texts, self.texts[at])).astype(np.uint64)) * np.uint64(BASE)
        return (out ^ (out >> np.uint64(32))).view(np.int64)

    def leave_out(self, not_later: np.ndarray) -> None:
        """Drop the windows inside later stretches."""
        at = self.long()
        at = at[~in_bitmap(not_later, self.spots(at))]
        inside = np.zeros(len(self.texts) + 1, dtype=np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + self.seed + 1, -1)
        self.at = self.at[np.cumsum(inside)[self.at] == 0]

    def rows(self, at: np.ndarray, size: int) -> pa.RecordBatch:
        """(content, doc_id, text_hash, first, spot) of the stretches of ``size`` words that begin at ``at``."""
        row = pa.array(self.texts[at])
        first = (at - np.searchsorted(self.texts, self.texts[at])).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(grams(self.hashes, size)[at].view(np.int64)), self.batch.column("doc_id").take(row), self.batch.column("text_hash").take(row),
                pa.array(first), pa.array(self.spots(at)),
            ],
            names=["content", "doc_id", "text_hash", "first", "spot"],
        )


def repeated_windows(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, first, last, of_doc_id): later stretches that cover every later window, and the document of their first occurrence."""
    rows = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text_hash"))
    share = docs.sparkSession.sparkContext.broadcast
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.struct("doc_id", "text_hash", "first")

    def each(make, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most=SLICE):
                yield make(batch)

        return rows.mapInArrow(run, schema)

    def repeated(make):
        return share(bitmap(each(make, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")))

    def meet(make, name: str) -> tuple[DataFrame, DataFrame]:
        """The stretches, and the first of each content that occurs again."""
        found = materialize(each(make, f"content long, doc_id {kind}, text_hash long, first int, spot long"), name)
        heads = found.groupBy("content").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # stored, so that the join is one of two plain tables, whose hot contents Spark can split
        return found, materialize(heads.select("content", "head"), f"{name}-heads")

    def later(found: DataFrame, heads: DataFrame, size: int) -> DataFrame:
        return found.join(heads, "content").where(place > F.col("head")).select(
            "doc_id", "text_hash", "first", (F.col("first") + F.lit(size - 1)).alias("last"), F.col("head.doc_id").alias("of_doc_id"),
        )

    bits = repeated(lambda batch: Slice(batch, words, seed).marks())

    def long(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = Slice(batch, words, seed, bits.value)
        return part.rows(part.long(), words + seed)

    stretches, stretch_heads = meet(long, "word-stretches")
    others = stretches.join(stretch_heads, "content", "left").where(F.col("head").isNull() | (place <= F.col("head")))
    not_later = share(bitmap(others, "spot"))

    def left(batch: pa.RecordBatch) -> Slice:
        part = Slice(batch, words, seed, bits.value)
        part.leave_out(not_later.value)
        return part

    again = repeated(lambda batch: left(batch).marks())

    def border(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = left(batch)
        part.keep(again.value)
        return part.rows(part.at, words)

    return later(stretches, stretch_heads, words + seed).union(later(*meet(border, "word-windows"), words))


def merge(found: pa.ListArray) -> pa.ListArray:
    """Later stretches of each document (first, last, of_doc_id) as runs of words; touching ones are one run."""
    sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(found)), sizes)
    flat = found.flatten()
    first, last = (pc.struct_field(flat, name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("first", "last"))
    order = np.lexsort((last, first, row))
    row, first, last = row[order], first[order], last[order]
    # the furthest word so far, the document in front of it
    reach = np.maximum.accumulate((row << 32) + last) if len(row) else row
    begins = np.concatenate(([0], np.flatnonzero((row << 32)[1:] + first[1:] > reach[:-1] + 1) + 1)) if len(row) else row
    ends = (reach & 0xFFFFFFFF)[np.append(begins[1:], len(row))[: len(begins)] - 1]
    runs = pa.StructArray.from_arrays(
        [pa.array(first[begins].astype(np.int32)), pa.array(ends.astype(np.int32)), pc.struct_field(flat, "of_doc_id").take(pa.array(order[begins]))],
        names=["first", "last", "of_doc_id"],
    )
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row[begins], minlength=len(found)))))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs)


def cut(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """(the text without the runs' words and the white space behind them, lines that lost words, words deleted)."""
    data = text.encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    ink = ~SPACES[raw]
    starts = np.flatnonzero(ink & ~np.concatenate(([False], ink[:-1])))
    begins = starts[[r["first"] for r in runs]].tolist()
    ends = [int(starts[r["last"] + 1]) if r["last"] + 1 < len(starts) else len(data) for r in runs]
    kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*begins, len(data)]))
    gone = np.concatenate([starts[r["first"] : r["last"] + 1] for r in runs])
    lines = len(np.unique(np.searchsorted(cuts(raw), gone, side="right")))
    return kept.decode(), lines, len(gone)


def dedup_runs(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The documents with repeated runs of words deleted from ``text``, plus removed_lines, removed_words and runs.

    removed_lines counts the lines (cut as in line_dedup) that lost words; runs
    is a sorted list of (first word, last word, document it repeats).  Columns of
    ``docs`` that already have such a name are replaced.
    """
    names = ("removed_lines", "removed_words", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = f"array<struct<first:int,last:int,of_doc_id:{kind}>>"
    # of one document
    later = repeated_windows(docs, words, seed).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last", "of_doc_id")).alias("found"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), merge(batch.column("found"))], names=["__id", "__hash", "__runs"])

    found = later.mapInArrow(merged, f"__id {kind}, __hash long, __runs {runs}")
    # only documents with something to delete are moved; a null text has no hash
    keyed = docs.withColumn("__key", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    marked = keyed.join(found, keyed["doc_id"].eqNullSafe(found["__id"]) & (keyed["__key"] == found["__hash"]), "left")
    kept = [c for c in docs.columns if c not in names]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = batch.column("__runs").to_pylist()
            texts, lines, words_gone = batch.column("text").to_pylist(), [0] * len(spans), [0] * len(spans)
            for i, span in enumerate(spans):
                if span:
                    texts[i], lines[i], words_gone[i] = cut(texts[i], span)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(words_gone, pa.int64()), batch.column("__runs")], names=[*kept, *names],
            )

    return marked.select(*kept, "__runs").mapInArrow(run, f"{schema}, `{names[0]}` long, `{names[1]}` long, `{names[2]}` {runs}")
