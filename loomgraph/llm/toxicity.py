"""Toxicity of whole texts from two Kneser-Ney models of words as character sequences.

For each class (toxic, ordinary) the probability of a character after the ORDER - 1
characters before it in its word is the discounted count of the class, plus the
mass that is left times a pooled estimate that both classes share; that estimate
is a Kneser-Ney model of its own over all labelled words, whose lower orders use
continuation counts.  Rare expressions therefore get the same probability from
both sides.  A word's evidence is the difference of its log-likelihoods; a text's
is the mean over its words less their median, so that what all words of a
language have in common does not count.  A logistic curve turns it into a score.

The models count every labelled row that is not held out, except those whose
remainder is CURVE_FOLD: these fit the curve.  All counts are made by Spark.
The result, a table of the log ratio of every known sequence and context, is sent
to the tasks while it has at most SHIPPED rows (characters in words saturate);
a larger one is joined with the vocabulary instead, with the same scores.

Results for odd input: a text without words, null or empty, has no evidence
(the curve's value at 0); rows that repeat are scored each; null ids are scored
but teach nothing; labels that are null teach nothing, and of several labels of
a document the largest counts; an empty table gives an empty table; without
labels every score is below 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bitmap, in_bitmap, slices, strings, text_of
from loomgraph.session import materialize

ORDER = 5
DISCOUNT = 0.75
#: Evidence above the text's median by which a word has to stand out.
FLOOR = 3.0
#: Weight of the shared estimate, in characters, besides the discounted mass.
SHARED = 20.0
CURVE_FOLD = 4
#: Rows of the log-ratio table that a task may hold (about 150 MB).
SHIPPED = 1_500_000
#: Words whose evidence a worker keeps.
CAPACITY = 600_000
#: Evidence is counted in steps of this size to fit the curve; beyond 2 it is 2.
BIN = 0.002
#: The curve without labels: (slope, evidence where the score is 0.5).
PRIOR_CURVE = (100.0, 0.05)
WORD = regex.compile(r"[\p{L}\p{N}]+")


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % 5


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold) of the labelled documents that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(known.select(F.xxhash64("doc_id").alias("hash"))))
    rows = docs.where(fold() != 0).select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(bits.value, batch.column("hash").to_numpy())
            yield batch.filter(pa.array(keep)).select(["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string").join(known, "doc_id").withColumn("fold", fold())


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, ordinary, toxic): how often each class has each word of (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = pc.ascii_split_whitespace(text_of(batch))
            toxic = batch.column("toxic").to_numpy() > 0
            of = np.repeat(toxic, np.diff(words.offsets.to_numpy()))
            coded = words.flatten().dictionary_encode()
            at, size = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
            ordinary, bad = np.bincount(at[~of], minlength=size), np.bincount(at[of], minlength=size)
            total: dict[str, tuple[int, int]] = {}
            for chunk, a, b in zip(strings(coded.dictionary), ordinary.tolist(), bad.tolist()):
                for word in WORD.findall(chunk.lower()):
                    x, y = total.get(word, (0, 0))
                    total[word] = (x + a, y + b)
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(total.keys(), pa.string()), pa.array([x for x, _ in total.values()], pa.int64()), pa.array([y for _, y in total.values()], pa.int64())],
                    names=["word", "ordinary", "toxic"],
                )

    found = rows.select("text", "toxic").mapInArrow(run, "word string, ordinary long, toxic long")
    return found.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _before(gram: str):
    return F.expr(f"left({gram}, length({gram}) - 1)")


def _after(gram: str):
    return F.expr(f"substring({gram}, 2)")


def pooled(top: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p): the Kneser-Ney probability of the last character of every sequence of ``top`` (gram, n)."""
    levels = [top.select("gram", "n")]
    for _ in range(order - 1):
        levels.append(levels[-1].groupBy(_after("gram").alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    levels = levels[::-1]
    single = materialize(levels[0], "gram-level")
    total, kinds = single.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not kinds:
        return single.select("gram", F.lit(0.0).alias("p"))
    base = DISCOUNT * kinds / total / (kinds + 1)
    known = single.select("gram", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / float(total) + base).alias("p"))
    for level in levels[1:]:
        level = level.withColumn("before", _before("gram")).withColumn("after", _after("gram"))
        context = level.groupBy("before").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        lower = known.select(F.col("gram").alias("after"), F.col("p").alias("lower"))
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("total")
        known = materialize(level.join(context, "before").join(lower, "after").select("gram", p.alias("p")), "gram-level")
    return known


def log_ratios(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, ratio): toxic less ordinary log-likelihood of every sequence seen, and of anything else after each context."""
    padded = F.concat(F.lit("^" * (order - 1)), "word", F.lit("$"))
    grams = words.select("ordinary", "toxic", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(order)))).alias("gram"))
    top = materialize(grams.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.sum(F.col("ordinary") + F.col("toxic")).alias("n")), "grams")
    shared = pooled(top, order)
    context = top.groupBy(_before("gram").alias("before")).agg(
        *[F.sum(c).alias(f"{c}_total") for c in ("ordinary", "toxic")], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("ordinary", "toxic")],
    )

    def log_p(c: str, own, p):
        return F.log((own + (DISCOUNT * F.col(f"{c}_kinds") + SHARED) * p) / (F.col(f"{c}_total") + SHARED))

    counted = top.withColumn("before", _before("gram")).join(context, "before").join(shared, "gram")
    kept = {c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) for c in ("ordinary", "toxic")}
    seen = counted.select(F.col("gram").alias("key"), (log_p("toxic", kept["toxic"], F.col("p")) - log_p("ordinary", kept["ordinary"], F.col("p"))).alias("ratio"))
    rest = context.select(F.col("before").alias("key"), (log_p("toxic", F.lit(0.0), F.lit(1.0)) - log_p("ordinary", F.lit(0.0), F.lit(1.0))).alias("ratio"))
    return materialize(seen.union(rest), "log-ratios")


class Evidence:
    """Evidence of words from a shipped log-ratio table; kept for the words met so far."""

    def __init__(self, keys: list[str], ratios: np.ndarray, order: int = ORDER) -> None:
        self.ratio = dict(zip(keys, ratios.tolist()))
        self.order = order
        self.place: dict[str, float] = {}

    def of_word(self, chunk: str) -> float:
        """Summed log ratios of the words in a piece of text without spaces; nan if it has none."""
        parts = WORD.findall(chunk.lower())
        if not parts:
            return math.nan
        total, ratio, order = 0.0, self.ratio, self.order
        for word in parts:
            text = "^" * (order - 1) + word + "$"
            for i in range(len(word) + 1):
                found = ratio.get(text[i : i + order])
                total += ratio.get(text[i : i + order - 1], 0.0) if found is None else found
        return total

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Mean of what each word's evidence exceeds the text's median by, beyond FLOOR; 0 without words."""
        words = pc.ascii_split_whitespace(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        coded = words.flatten().dictionary_encode()
        names = strings(coded.dictionary)
        if len(self.place) + len(names) > CAPACITY:
            self.place.clear()
        place = self.place
        for name in names:
            if name not in place:
                place[name] = self.of_word(name)
        local = np.fromiter((place[w] for w in names), dtype=float, count=len(names))
        value = local[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0)
        good = ~np.isnan(value)
        row, value = row[good], value[good]
        order = np.lexsort((value, row))
        value = value[order]
        counts = np.bincount(row, minlength=len(texts))
        first = np.cumsum(counts) - counts
        some = counts > 0
        middle, out = np.zeros(len(texts)), np.zeros(len(texts))
        low, high = first[some] + (counts[some] - 1) // 2, first[some] + counts[some] // 2
        middle[some] = (value[low] + value[high]) / 2
        beyond = np.maximum(value - middle[row[order]] - FLOOR, 0)
        out[some] = np.bincount(row[order], weights=beyond, minlength=len(texts))[some] / counts[some]
        return out


#: The evidence of the model that this Python worker used last, by the id of its broadcast.
_LOADED: dict[str, Evidence] = {}


def _evidence(name: str, shared) -> Evidence:
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Evidence(*shared.value)
    return _LOADED[name]


def shipped(rows: DataFrame, ratios: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and the evidence of (text); the table goes to every task."""
    import uuid

    table = ratios.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((table.column("key").to_pylist(), table.column("ratio").to_numpy()))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _evidence(name, shared)
        for batch in slices(batches):
            found = model.of_texts(text_of(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found)], names=[*keep, "evidence"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(run, f"{schema}, evidence double")


def joined(rows: DataFrame, ratios: DataFrame, keep: tuple[str, ...], order: int = ORDER) -> DataFrame:
    """The same as ``shipped`` by joins with the vocabulary, for a table of any size."""
    stored = materialize(rows.select(*keep, "text"), "texts").withColumn("row", F.monotonically_increasing_id())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pc.ascii_split_whitespace(text_of(batch))
            row = np.repeat(batch.column("row").to_numpy(), np.diff(found.offsets.to_numpy()))
            table = pa.table({"row": row, "chunk": found.flatten().cast(pa.string())}).group_by(["row", "chunk"]).aggregate([([], "count_all")])
            yield from table.rename_columns(["row", "chunk", "n"]).combine_chunks().to_batches()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk in batch.column("chunk").to_pylist():
                for word in WORD.findall(chunk.lower()):
                    text = "^" * (order - 1) + word + "$"
                    out += [(chunk, text[i : i + order], text[i : i + order - 1]) for i in range(len(word) + 1)]
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (a, b, c)], names=["chunk", "gram", "before"])

    counted = stored.select("row", "text").mapInArrow(words, "row long, chunk string, n long")
    parts = counted.select("chunk").distinct().mapInArrow(grams, "chunk string, gram string, before string")
    own = ratios.select(F.col("key").alias("gram"), F.col("ratio").alias("own"))
    rest = ratios.select(F.col("key").alias("before"), F.col("ratio").alias("rest"))
    value = parts.join(own, "gram", "left").join(rest, "before", "left").groupBy("chunk").agg(F.sum(F.coalesce("own", "rest", F.lit(0.0))).alias("value"))
    # one list per document, of its own words
    each = counted.join(value, "chunk").groupBy("row").agg(
        F.sum("n").alias("total"), F.percentile("value", F.lit(0.5), F.col("n")).alias("middle"), F.collect_list(F.struct("value", "n")).alias("words"),
    )
    beyond = F.aggregate("words", F.lit(0.0), lambda s, w: s + w["n"] * F.greatest(w["value"] - F.col("middle") - FLOOR, F.lit(0.0)))
    each = each.select("row", (beyond / F.col("total")).alias("evidence"))
    return stored.drop("text").join(each, "row", "left").select(*keep, F.coalesce("evidence", F.lit(0.0)).alias("evidence"))


def evidence(rows: DataFrame, ratios: DataFrame, keep: tuple[str, ...] = ("doc_id",), most: int = SHIPPED) -> DataFrame:
    """The columns ``keep`` and the evidence of every text."""
    return (shipped if ratios.count() <= most else joined)(rows, ratios, keep)


def curve(scored: DataFrame) -> tuple[float, float]:
    """(slope, place of 0.5) of the logistic curve for (evidence, toxic), from counts per step of evidence."""
    step = F.least(F.lit(2.0), F.round(F.col("evidence") / BIN) * BIN)
    counts = scored.groupBy(step.alias("x")).agg(F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good"))
    table = np.array([tuple(r) for r in counts.toLocalIterator()], dtype=float).reshape(-1, 3)  # 1001 rows at most
    x, bad, good = table[np.argsort(table[:, 0])].T
    if not bad.sum() or not good.sum():
        return PRIOR_CURVE
    slope, shift = PRIOR_CURVE[0], -PRIOR_CURVE[0] * PRIOR_CURVE[1]
    for _ in range(100):  # Newton's steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -50, 50)))
        miss, w = bad - (bad + good) * p, (bad + good) * p * (1 - p)
        g = np.array([(miss * x).sum() - 1e-3 * slope, miss.sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), [-20, -5], [20, 5])
        slope, shift = slope + move[0], shift + move[1]
        if abs(move).max() < 1e-6:
            break
    return (slope, -shift / slope) if slope > 0 else PRIOR_CURVE


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), most: int = SHIPPED) -> DataFrame:
    """The columns ``keep``, the evidence and the score of every document of (doc_id, text)."""
    known = materialize(labelled(docs, labels), "labelled")
    ratios = log_ratios(materialize(word_counts(known.where(F.col("fold") != CURVE_FOLD)), "words"))
    slope, middle = curve(evidence(known.where(F.col("fold") == CURVE_FOLD), ratios, ("doc_id", "toxic"), most))
    found = evidence(docs, ratios, keep, most)
    return found.withColumn("score", 1 / (1 + F.exp(-F.lit(slope) * (F.col("evidence") - F.lit(middle)))))
