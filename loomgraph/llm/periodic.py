"""Periodic runs of words, found by seeds on the diagonals of a document.

A run is a stretch of words with smallest period q, of LEAST words and TIMES
periods or more, that cannot be made longer.  Shifted by its period it overlaps
itself on at least ``overlap(q)`` words, so a document holds the run's first
``overlap(q)``-gram twice, q words apart.

1. Seeds.  Lags are taken in classes [Q, 2Q).  The grams of a class have the
   least overlap of its lags, ``overlap(Q)`` words, which is no less than any of
   the lags.  Of a primitive period no such gram of a run recurs earlier than q
   words later, so the next occurrence in the document is the pair to look at:
   one pair for each place and class, however often a gram recurs.  Grams are
   compared by names (a doubling of names of half their length), not by hashes;
   places whose shorter gram does not recur leave all later classes.
2. Extension.  A seed is extended both ways on its diagonal, word by word.  For
   every lag the furthest place covered so far is kept; seeds before it are part
   of an extension that is done.
3. What is long enough is a run.  Its lag is its smallest period: by a smaller
   one the seed's gram would have recurred earlier.

All words of a run behind its first period are dropped in ``collapsed``.  A
document is the unit of work; the texts of a batch are handled together.

Results for odd input: a null text is an empty one, without words and runs;
white space is ASCII's, words differ by case; rows that repeat are handled one
by one; a null doc_id stays null; other columns, whatever their names, are not
looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomgraph.llm.arrow import slices, text_of

LEAST = 6
TIMES = 4
#: Words compared first when a seed is extended; doubled until a difference is met.
STEP = 64
RUNS = "array<struct<start:long,length:long,period:long>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def overlap(lag: int, least: int = LEAST, times: int = TIMES) -> int:
    """Words that a run of this period at least shares with itself, shifted by the period."""
    return max(least, times * lag) - lag


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, text) of all words of some texts, in order, and the first word of every text (and the end)."""
    words = pc.ascii_split_whitespace(texts)
    numbered = words.flatten().dictionary_encode()
    kept = pc.not_equal(numbered.dictionary, "").to_numpy(zero_copy_only=False)  # white space at a border leaves an empty word
    codes = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = words.offsets.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if not kept.all():
        some = kept[codes]
        codes, text = codes[some], text[some]
    return codes, text, np.searchsorted(text, np.arange(len(texts) + 1))


def grouped(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs more than once, in the order of (key, place), and the number of their key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    begins = np.concatenate(([True], ~same))
    kept = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    return at[order[kept]], np.cumsum(begins)[kept]


def seeds(codes: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the seeds of all texts, in the order of (lag, place)."""
    n = len(codes)
    vocabulary = int(codes.max()) + 1 if n else 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # names of the grams of m words that recur in their text, -1 for all others
    m, name, alive = 1, text * vocabulary + codes, np.arange(n)
    low = 1

    def pairs(offset: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the grams of m + offset words whose two parts recur."""
        at = alive[alive + offset < n]
        at = at[(name[at + offset] >= 0) & (text[at] == text[at + offset])]
        return at, name[at] * vocabulary + codes[at + offset] if m == 1 else name[at] * (int(name.max()) + 1) + name[at + offset]

    while len(alive):
        gram = overlap(low, least, times)
        while 2 * m <= gram and len(alive):
            at, key = pairs(m)
            if not len(at):
                return _sorted(found)
            at, number = grouped(key, at)
            name = np.full(n, -1, dtype=np.int64)
            name[at] = number
            m, alive = 2 * m, np.sort(at)
        if not len(alive):
            break
        at, key = pairs(gram - m) if gram > m else (alive, name[alive])
        if len(at):
            at, number = grouped(key, at)
            lag = np.diff(at)
            near = (number[1:] == number[:-1]) & (lag >= low) & (lag < 2 * low)
            found.append((at[:-1][near], lag[near]))
        low *= 2
    return _sorted(found)


def _sorted(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place, lag = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def reach(codes: np.ndarray, at: int, lag: int, end: int, way: int) -> int:
    """From ``at`` as far as words agree with those ``lag`` further on: the first place (way 1) that does not, or the last before which one does not (way -1)."""
    step = STEP
    while at != end:
        to = min(end, at + step) if way > 0 else max(end, at - step)
        a, b = min(at, to), max(at, to)
        other = np.flatnonzero(codes[a:b] != codes[a + lag : b + lag])
        if len(other):
            return a + int(other[0]) if way > 0 else a + int(other[-1]) + 1
        at, step = to, 2 * step
    return at


def runs_of(codes: np.ndarray, text: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of every run, by text, in the order of (start, period)."""
    place, lag = seeds(codes, text, least, times)
    # of seeds side by side on one diagonal the first leads to the same extension
    first = np.flatnonzero(np.concatenate(([True], (np.diff(lag) != 0) | (np.diff(place) != 1)))[: len(place)])
    covered: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    for at, q in zip(place[first].tolist(), lag[first].tolist()):
        if at < covered.get(q, 0):
            continue
        of = int(text[at])
        begin = reach(codes, at, q, int(bounds[of]), -1)
        stop = reach(codes, at, q, int(bounds[of + 1]) - q, 1)
        covered[q] = stop
        if stop - begin + q >= max(least, times * q):
            out.setdefault(of, []).append((begin - int(bounds[of]), stop - begin + q, q))
    for found in out.values():
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(data: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those behind the first period of a run."""
    words = data.split()
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: (doc_id, n_words, runs, collapsed); runs by start, then period, counted in words from 0."""
    if times < 3 or least < 2:
        raise ValueError("runs need at least three periods and two words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, of, bounds = coded(text_of(batch))
            found = runs_of(codes, of, bounds, least, times)
            runs, kept = [], []
            for i, value in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                own = found.get(i, [])
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                kept.append(collapse(value or b"", own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(runs, RUN_TYPE), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")
