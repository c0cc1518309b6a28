"""Removal of repeated runs of lines found by winnowing over line hashes.

A line is what stands between line breaks; a long line is cut after the end of
each sentence, so that a passage pasted into a paragraph is made of whole lines
too.  For every start the shortest stretch of lines with at least WORDS words is
a window, and so is the shortest one for every end.  The line of a window with
the smallest hash, among its longer lines if it has any, is its fingerprint: two
texts with a common run of WORDS words have a window in common, and with it a
fingerprint.

1. Winnowing: hashes that are a fingerprint at one place only are dropped; what
   is left of them is a bitmap of fixed size.
2. Positions: windows with a repeated fingerprint meet under their content; the
   first of each (smallest doc_id, text hash, start) is kept by a partial
   aggregate, so no pairs within a group are made.
3. Extension: a later window is repeated, whatever it overlaps.  Windows by start
   reach every run's left border and windows by end its right border, so the
   union of the repeated windows is each match at its full length both ways.
4. Lines in that union are deleted; the first occurrence stays.

Results for odd input: a null text stays null; blank lines count no words and go
only with what surrounds them; rows with equal (doc_id, text) are one document
and get the same result; a null doc_id sorts first; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bitmap, in_bitmap, slices
from loomgraph.session import materialize

WORDS = 50
#: Lines with fewer words, often common phrases, are fingerprints only of windows without a longer line.
LONG = 6
#: Bytes that end a sentence, and white space within and of all kinds.
ENDS, BLANKS, SPACES = (np.isin(np.arange(256), list(b)) for b in (b".!?", b" \t", b" \t\n\r\x0b\f"))
BASE = 0x9E3779B97F4A7C15
#: BASE * UNBASE = 1 modulo 2^64
UNBASE = pow(BASE, -1, 1 << 64)
SLICE = 4 << 20


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where lines end in UTF-8 bytes: after a line break, and after the blanks behind the end of a sentence."""
    breaks = np.flatnonzero(raw == 10) + 1
    if len(raw) < 2:
        return breaks
    blank = BLANKS[raw]
    first = np.flatnonzero(blank[1:] & ENDS[raw[:-1]]) + 1
    # where runs of blanks end, the last perhaps with the text
    over = np.append(np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, len(raw))
    out = np.concatenate((breaks, over[np.searchsorted(over, first, side="right")]))
    out.sort()
    return out[np.concatenate(([True], np.diff(out) > 0))] if len(out) else out


def lines_of(text: str) -> list[str]:
    """The lines of a text, with the white space that ends them; joined they are the text."""
    data = text.encode()
    ends = np.union1d(cuts(np.frombuffer(data, dtype=np.uint8)), [len(data)] if data else []).astype(np.int64).tolist()
    return [data[a:b].decode() for a, b in zip([0, *ends], ends)]


def keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What windows choose their fingerprint by: the hash, short lines after all others."""
    return (hashes.view(np.uint64) >> np.uint64(1)) | ((counts < LONG).astype(np.uint64) << np.uint64(63))


def windows(hashes: np.ndarray, counts: np.ndarray, texts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of lines with their (first, last, fingerprint, content hash).

    ``hashes``, ``counts`` and ``texts`` give the hash, the words and the text
    number of every line, in order.
    """
    n = len(hashes)
    empty = np.zeros(0, dtype=np.int64)
    if not n:
        return empty, empty, empty, empty
    total = np.concatenate(([0], np.cumsum(counts)))
    index = np.arange(n)
    # by start: the first end with enough words; by end: the last start with enough words
    ends = np.searchsorted(total, total[:-1] + words, side="left") - 1
    starts = np.searchsorted(total, total[1:] - words, side="right") - 1
    first = np.concatenate((index, starts))
    last = np.concatenate((ends, index))
    # lines without words at a border are no part of a window
    good = (first >= 0) & (last < n)
    first, last = first[good], last[good]
    good = (texts[first] == texts[last]) & (counts[first] > 0) & (counts[last] > 0)
    pair = np.unique(first[good] * (n + 1) + last[good])
    first, last = pair // (n + 1), pair % (n + 1)
    if not len(first):
        return empty, empty, empty, empty
    # smallest hash of each window: minima of stretches of 1, 2, 4, ... lines
    size = last - first + 1
    level = np.frexp(size)[1] - 1
    unsigned, fingerprint = hashes.view(np.uint64), np.zeros(len(first), dtype=np.uint64)
    low = keys(hashes, counts)
    for k in range(int(level.max()) + 1):
        rows = level == k
        fingerprint[rows] = np.minimum(low[first[rows]], low[last[rows] - (1 << k) + 1])
        step = 1 << k
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low
    # content: a polynomial of the hashes, the same wherever the window stands
    with np.errstate(over="ignore"):
        up, down = (np.full(n, b, dtype=np.uint64) for b in (BASE, UNBASE))
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.concatenate(([np.uint64(0)], np.add.accumulate(unsigned * up)))
        content = (sums[last + 1] - sums[first]) * down[first] + size.astype(np.uint64)
        content ^= content >> np.uint64(29)
        content *= np.uint64(0xBF58476D1CE4E5B9)
        content ^= content >> np.uint64(32)
    return first, last, fingerprint.view(np.int64), content.view(np.int64)


def _measured(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, text number) of all lines of some texts."""
    data = [(t or "").encode() for t in texts]
    joined = b"\n".join([*data, b""])  # a blank line more at the end of a text changes no window
    raw = np.frombuffer(joined, dtype=np.uint8)
    ends = cuts(raw)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b].strip()) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)
    ink = ~SPACES[raw]
    heads = np.flatnonzero(ink[1:] & ~ink[:-1]) + 1  # where words begin, but for the very first byte
    words = np.searchsorted(heads, ends) - np.searchsorted(heads, starts)
    words[:1] += ink[:1]
    number = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
    return hashes.view(np.int64), words, number


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            hashes, counts, texts = _measured(batch.column("text").to_pylist())
            first, _, fingerprint, _ = windows(hashes, counts, texts, words)
            # one place per text, or two where the text has the line itself twice
            with np.errstate(over="ignore"):
                mixed = (keys(hashes, counts) + texts.astype(np.uint64)) * np.uint64(BASE)
                own = (fingerprint.view(np.uint64) + texts[first].astype(np.uint64)) * np.uint64(BASE) if len(first) else np.zeros(0, dtype=np.uint64)
            line, times = np.unique(mixed, return_counts=True)
            own, at = np.unique(own, return_index=True)
            value, times = fingerprint[at], times[np.searchsorted(line, own)]
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times)], names=["hash", "n"])

    return run


def repeated_windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, first, last, of_doc_id, of_text_hash, of_first): every later window and its first occurrence."""
    rows = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    marks = rows.select("text").mapInArrow(_fingerprints(words), "hash long, n long")
    repeated = marks.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(repeated))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            hashes, counts, texts = _measured(batch.column("text").to_pylist())
            first, last, fingerprint, content = windows(hashes, counts, texts, words)
            keep = in_bitmap(bits.value, fingerprint)
            first, last, content = first[keep], last[keep], content[keep]
            row = texts[first] if len(first) else first
            begin = np.searchsorted(texts, row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(content), batch.column("doc_id").take(pa.array(row)), batch.column("text_hash").take(pa.array(row)),
                    pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32)),
                ],
                names=["content", "doc_id", "text_hash", "first", "last"],
            )

    found = rows.mapInArrow(run, f"content long, doc_id {kind}, text_hash long, first int, last int")
    found = materialize(found, "windows")
    place = F.struct("doc_id", "text_hash", "first")
    heads = found.groupBy("content").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # stored, so that the join is one of two plain tables, whose hot contents Spark can split
    heads = materialize(heads.select("content", "head"), "window-heads")
    later = found.join(heads, "content").where(place > F.col("head")).drop("content")
    return later.select(
        "doc_id", "text_hash", "first", "last",
        F.col("head.doc_id").alias("of_doc_id"), F.col("head.text_hash").alias("of_text_hash"), F.col("head.first").alias("of_first"),
    )


def repeated_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, runs): the stretches of lines to delete, each with the document it repeats.

    ``runs`` is a sorted list of (first, last, of_doc_id); touching windows are one run.
    """
    later = repeated_windows(docs, words)
    entry = F.struct("first", "last", "of_doc_id")
    lists = later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(entry)).alias("windows"))  # of one document
    kind = docs.schema["doc_id"].dataType.simpleString()
    merged = F.aggregate(
        "windows",
        F.expr(f"cast(array() as array<struct<first:int,last:int,of_doc_id:{kind}>>)"),
        lambda runs, w: F.when(
            (F.size(runs) > 0) & (w["first"] <= F.element_at(runs, -1)["last"] + 1),
            F.concat(
                F.slice(runs, 1, F.size(runs) - 1),
                F.array(F.struct(
                    F.element_at(runs, -1)["first"].alias("first"), F.greatest(F.element_at(runs, -1)["last"], w["last"]).alias("last"),
                    F.element_at(runs, -1)["of_doc_id"].alias("of_doc_id"),
                )),
            ),
        ).otherwise(F.concat(runs, F.array(w))),
    )
    return lists.select("doc_id", "text_hash", merged.alias("runs"))


def cut(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(the text without the lines of the runs, lines deleted, words deleted)."""
    lines = lines_of(text)
    gone = np.zeros(len(lines), dtype=bool)
    for first, last in runs:
        gone[first : last + 1] = True
    kept = "".join(line for line, drop in zip(lines, gone) if not drop)
    return kept, int(gone.sum()), sum(len(line.encode().split()) for line, drop in zip(lines, gone) if drop)


def dedup_lines(docs: DataFrame, words: int = WORDS, names: tuple[str, str, str] = ("removed_lines", "removed_words", "runs")) -> DataFrame:
    """The documents with repeated runs deleted from ``text``, plus lines and words deleted and the runs, under ``names``.

    Columns of ``docs`` that already have such a name are replaced.
    """
    runs = repeated_runs(docs, words).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("runs").alias("__runs"))
    # only documents with something to delete are moved; a null text has no hash
    keyed = docs.withColumn("__key", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    marked = keyed.join(runs, keyed["doc_id"].eqNullSafe(runs["__id"]) & (keyed["__key"] == runs["__hash"]), "left").drop("__id", "__hash", "__key")
    kept = [c for c in docs.columns if c not in names]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = batch.column("__runs").to_pylist()
            texts, lines, words_gone = batch.column("text").to_pylist(), [0] * len(spans), [0] * len(spans)
            for i, found in enumerate(spans):
                if found:
                    texts[i], lines[i], words_gone[i] = cut(texts[i], [(r["first"], r["last"]) for r in found])
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(words_gone, pa.int64()), batch.column("__runs")],
                names=[*kept, *names],
            )

    marked = marked.select(*kept, "__runs")
    return marked.mapInArrow(run, f"{schema}, `{names[0]}` long, `{names[1]}` long, `{names[2]}` array<struct<first:int,last:int,of_doc_id:{kind}>>")


def drop_repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents without repeated runs; documents of which nothing but white space is left go.

    A column n_chars follows the text where lines are deleted.
    """
    found = dedup_lines(docs, words, ("__lines", "__words", "__found"))
    emptied = (F.col("__lines") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    kept = found.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)
