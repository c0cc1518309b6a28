"""Benchmark questions in documents, even with other numbers, names or units.

Words become tokens of a template: numbers, names (capitalised inside a sentence)
and units become typed placeholders, everything else is its letters and digits
in lower case.  Windows of WINDOW tokens are hashed and joined with the windows
of the benchmark; a shorter item of at least SHORTEST tokens is one window of its
own length, a window of fewer than SHORTEST words besides placeholders is none.
With ``dense``, items without any such window are looked for too: by windows that
go on from each start until they hold SHORTEST words besides placeholders, or, if
the item has fewer of those, as a whole with its own values (SHORTEST tokens or more).
What stood in the slots of both sides of a match is then compared: within one
occurrence (windows with the same distance between their places) every value of
the question must stand for one value of the document.  A document is
contaminated by an item if consistent windows cover at least COVERAGE of it.

The document side never leaves its tasks except for windows whose hash is in a
bitmap of fixed size over the benchmark's hashes; the join that follows is exact
and compares the hashes of two different polynomials.

Results for odd input: null or empty texts and items match nothing; items with
equal text are one item (the smallest id); rows that repeat are reported once
per document id; a null item id stays null; empty tables give an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bitmap, in_bitmap, slices, strings, text_of
from loomgraph.session import materialize

WINDOW = 8
SHORTEST = 5
COVERAGE = 0.3
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
#: Units of measure and money that a re-worded question may exchange.
UNITS = frozenset(
    "m cm mm km inch inches ft foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces oz ton tons liter liters litre litres l ml "
    "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees "
    "dollar dollars cent cents euro euros usd eur gbp kmh mph".split()
)
#: Number words count as numbers.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
INK = regex.compile(r"[\p{L}\p{N}]+(?:['’.,][\p{L}\p{N}]+)*")
SENTENCE_ENDS = (".", "!", "?", ":", ";")
KIND_HASH = {kind: xxhash.xxh64_intdigest(kind, 1) for kind in (NUMBER, NAME, UNIT)}
#: Bases of the two window hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CAPACITY = 300_000


class Words:
    """What a word is in a template: hash inside a sentence and at its start, and whether a sentence ends with it."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.inside: list[int] = []
        self.start: list[int] = []
        self.exact: list[int] = []
        self.flags: list[int] = []

    def add(self, word: str) -> int:
        """Keep a word; flags: 1 it has a core, 2 it ends a sentence, 4 slot inside a sentence, 8 slot at its start."""
        m = INK.search(word)
        flags = 2 if word.rstrip("\"')]”’»").endswith(SENTENCE_ENDS) else 0
        inside = start = exact = 0
        if m:
            core, low = m.group(), m.group().lower()
            exact = xxhash.xxh64_intdigest(low, 0)
            flags |= 1
            if low[0].isdigit() or low in NUMBER_WORDS:
                inside = start = KIND_HASH[NUMBER]
                flags |= 12
            elif low in UNITS:
                inside = start = KIND_HASH[UNIT]
                flags |= 12
            else:
                inside = start = exact
                if core[0].isupper() and len(core) > 1:
                    inside = KIND_HASH[NAME]
                    flags |= 4
        self.inside.append(inside)
        self.start.append(start)
        self.exact.append(exact)
        self.flags.append(flags)
        self.place[word] = at = len(self.place)
        return at

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(hash, slot?, text number, word, hash of the value) of the template tokens of all texts, in order."""
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten()
        text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        coded = flat.dictionary_encode()
        names = strings(coded.dictionary)
        if len(self.place) + len(names) > CAPACITY:
            self.clear()
        found = [self.add(w) if at is None else at for w, at in zip(names, map(self.place.get, names))]
        code = coded.indices.to_numpy(zero_copy_only=False)
        flags = np.array([self.flags[i] for i in found], dtype=np.uint8)[code]
        inside = np.array([self.inside[i] for i in found], dtype=np.uint64)[code]
        start = np.array([self.start[i] for i in found], dtype=np.uint64)[code]
        kept = np.flatnonzero(flags & 1)
        # a token starts a sentence if it is the first of its text or any word since the token before ended one
        ended = np.concatenate(([0], np.cumsum((flags & 2) > 0)))
        before = np.concatenate(([-1], kept[:-1]))
        at_start = np.ones(len(kept), dtype=bool)
        if len(kept):
            at_start[1:] = (ended[kept[1:]] - ended[before[1:]] > 0) | (text[kept[1:]] != text[before[1:]])
        hashes = np.where(at_start, start[kept], inside[kept])
        slot = np.where(at_start, flags[kept] & 8, flags[kept] & 4) > 0
        exact = np.array([self.exact[i] for i in found], dtype=np.uint64)[code]
        return hashes, slot, text[kept], flat.take(pa.array(kept)), exact[kept]


@functools.cache
def words() -> Words:
    """The words of this Python worker."""
    return Words()


def window_hashes(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``size`` tokens in a row, as signed longs."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(base) + hashes[k : k + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out += np.uint64(size)
    return out.view(np.int64)


def stretch_hashes(hashes: np.ndarray, at: np.ndarray, sizes: np.ndarray | int, base: int) -> np.ndarray:
    """A hash of the ``sizes`` tokens from each place of ``at``, as signed longs."""
    n = len(hashes) + 1
    with np.errstate(over="ignore"):
        up, down = (np.full(n, b, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.concatenate(([np.uint64(0)], np.add.accumulate(hashes * up[:-1])))
        out = (sums[at + sizes] - sums[at]) * down[at]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _windows(texts: pa.Array, sizes: list[int], whole: bool, bits: np.ndarray | None, dense: bool = False) -> Iterator[tuple]:
    """(text number, place, window size, hash, second hash, slot values) of windows with enough plain words.

    ``whole``: windows shorter than WINDOW only where they are a whole text.
    ``dense`` adds longer windows, as far as enough plain words take, and exact
    ones of the sizes -n in ``sizes`` (with ``whole``: both only for texts without
    other windows, the exact ones for those without longer windows either).
    """
    hashes, slot, text, word, exact = words().tokens(texts)
    counts = np.bincount(text, minlength=len(texts))
    first = np.cumsum(counts) - counts
    plain = np.concatenate(([0], np.cumsum(~slot)))
    bare = np.ones(len(texts), dtype=bool)
    for size in sizes:
        if size < 0 or size > WINDOW:
            continue
        one = window_hashes(hashes, size, BASES[0])
        if not len(one):
            continue
        at = np.arange(len(one)) if bits is None else np.flatnonzero(in_bitmap(bits, one))
        at = at[(text[at] == text[at + size - 1]) & (plain[at + size] - plain[at] >= SHORTEST)]
        if whole and size < WINDOW:
            at = at[counts[text[at]] == size]
        if not len(at):
            continue
        bare[text[at]] = False
        two = window_hashes(hashes, size, BASES[1])
        for i in at.tolist():
            slots = [(int(k - i), INK.search(word[int(k)].as_py()).group().lower()) for k in np.flatnonzero(slot[i : i + size]) + i]
            yield int(text[i]), int(i - first[text[i]]), size, int(one[i]), int(two[i]), slots
    if not dense or not len(hashes):
        return
    # from each place until SHORTEST plain words are reached
    at = np.arange(len(hashes))
    end = np.searchsorted(plain, plain[:-1] + SHORTEST)
    at = at[(end - at > WINDOW) & (end <= (first + counts)[text])]
    if whole:
        at = at[bare[text[at]]]
    one = stretch_hashes(hashes, at, end[at] - at, BASES[0])
    if bits is not None:
        good = in_bitmap(bits, one)
        at, one = at[good], one[good]
    two = stretch_hashes(hashes, at, end[at] - at, BASES[1])
    for i, x, y in zip(at.tolist(), one.tolist(), two.tolist()):
        slots = [(int(k - i), INK.search(word[int(k)].as_py()).group().lower()) for k in np.flatnonzero(slot[i : end[i]]) + i]
        yield int(text[i]), int(i - first[text[i]]), int(end[i] - i), x, y, slots
    bare[text[at]] = False
    # with their own values
    for size in np.unique(counts[bare & (counts >= SHORTEST)]).tolist() if whole else [-x for x in sizes if x < 0]:
        if whole:
            at = first[bare & (counts == size)]
        else:
            at = np.arange(max(0, len(hashes) - size + 1))
            at = at[text[at] == text[at + size - 1]]
        one = stretch_hashes(exact, at, size, BASES[0])
        if bits is not None:
            good = in_bitmap(bits, one)
            at, one = at[good], one[good]
        two = stretch_hashes(exact, at, size, BASES[1])
        for i, x, y in zip(at.tolist(), one.tolist(), two.tolist()):
            yield int(text[i]), int(i - first[text[i]]), -size, x, y, []


SCHEMA = "place int, size int, hash long, second long, slots array<struct<at:int,value:string>>"
SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())]))


def _emit(column: str, sizes: list[int], whole: bool, bits=None, dense: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(_windows(text_of(batch), sizes, whole, None if bits is None else bits.value, dense))
            text, place, size, one, two, slots = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(column).take(pa.array(text, pa.int64())), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()), pa.array([[{"at": a, "value": v} for a, v in s] for s in slots], SLOTS),
                ],
                names=[column, "place", "size", "hash", "second", "slots"],
            )

    return run


def item_windows(benchmark: DataFrame, dense: bool = False) -> DataFrame:
    """(item_id, place, size, hash, second, slots) of all windows of the benchmark's distinct texts."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(_emit("item_id", list(range(SHORTEST, WINDOW + 1)), True, dense=dense), f"item_id {kind}, {SCHEMA}")


def matches(docs: DataFrame, benchmark: DataFrame, dense: bool = False) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, slots_changed) of every contaminated document and item."""
    items = materialize(item_windows(benchmark, dense), "item-windows")
    sizes = sorted(r[0] for r in items.select("size").distinct().toLocalIterator())  # no more than items have lengths
    dense = dense and any(size < 0 or size > WINDOW for size in sizes)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(items))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.where("text is not null").select("doc_id", "text").mapInArrow(_emit("doc_id", sizes, False, bits, dense), f"doc_id {kind}, {SCHEMA}")
    theirs = items.select("item_id", F.col("place").alias("item_place"), "size", "hash", "second", F.col("slots").alias("item_slots"))
    hits = found.join(theirs, ["hash", "second", "size"]).withColumn("shift", F.col("place") - F.col("item_place"))
    hits = materialize(hits.select("doc_id", "item_id", "item_place", "shift", "slots", "item_slots"), "template-hits")
    # one row per slot; a question's value with two values in one occurrence makes the windows around it inconsistent
    pairs = hits.select("doc_id", "item_id", "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(
        "doc_id", "item_id", "shift", F.col("s.item_slots.value").alias("asked"), F.col("s.slots.value").alias("found"),
    )
    torn = pairs.groupBy("doc_id", "item_id", "shift", "asked").agg(F.countDistinct("found").alias("n"), F.max(F.col("found") != F.col("asked")).alias("changed"))
    torn = torn.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set(F.when(F.col("n") > 1, F.col("asked"))).alias("torn"), F.max("changed").alias("changed"),
    )
    torn = torn.withColumnsRenamed({"doc_id": "__doc", "item_id": "__item", "shift": "__shift"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("shift") == F.col("__shift"))
    judged = hits.join(torn, same, "left")
    good = judged.where(F.col("torn").isNull() | ~F.exists("item_slots", lambda s: F.array_contains("torn", s["value"])))
    covered = good.groupBy("doc_id", "item_id").agg(
        F.countDistinct("item_place").alias("windows"), F.coalesce(F.max("changed"), F.lit(False)).alias("slots_changed"),
    )
    totals = items.groupBy(F.col("item_id").alias("__item")).agg(F.countDistinct("place").alias("item_windows"))
    out = covered.join(totals, F.col("item_id").eqNullSafe(F.col("__item")))
    share = F.col("windows") / F.col("item_windows")
    return out.where(share >= COVERAGE).select("doc_id", "item_id", "windows", "item_windows", share.alias("coverage"), "slots_changed")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates."""
    bad = matches(docs, benchmark, dense=True).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]), "left_anti")
