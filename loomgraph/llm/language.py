"""Language of whole texts by a small convolutional network over bytes.

Every text is cut into windows of WINDOW bytes (each byte of it is in one; the
last is filled with zeros).  Filters of several widths slide over a window,
their largest responses go through a softmax layer, and the mean of the window
probabilities, weighted by window length, decides.  Trained in numpy on the
driver with stochastic gradient descent; applied in batches of windows inside
tasks.

Training uses at most PER_LANGUAGE documents per language and WINDOWS windows of
each: ids fall into CLASSES hash classes, of which each gives its first few by
another hash.  That is a fixed bound on what the driver collects, and no task
ranks the whole of a language.  Predictions read whole texts.

Results for odd input: a null text or one without a letter is ``und`` with
score 0; rows that repeat are predicted each; null ids are kept; languages that
are null teach nothing; an empty table gives an empty table, and without any
labelled row every document is ``und``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.arrow import grouped_sums

WINDOW = 256
#: Filters of each width in bytes.
WIDTHS = {2: 16, 3: 16, 4: 16}
PER_LANGUAGE = 300
CLASSES = 60
WINDOWS = 6
EPOCHS = 6
BATCH = 64
RATE = 0.05
SEED = 7
UNKNOWN = "und"
#: Windows that are scored at a time.
STEP = 4096
#: Bytes that one slice of texts has at most, unless one text is longer.
SLICE = 2 << 20


@dataclass
class Network:
    """Filter tables by width (position, byte, filter), the output layer and the languages."""

    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str]

    def pooled(self, windows: np.ndarray, want_places: bool = False) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Largest response of every filter in every window (window, filter), and where it was."""
        parts, places = [], {}
        for width, table in self.filters.items():
            # a pair of bytes is looked up at once
            joint = (table[0][:, None, :] + table[1][None, :, :]).reshape(65536, -1)
            tail = (table[2][:, None, :] + table[3][None, :, :]).reshape(65536, -1) if width == 4 else None
            codes = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
            best = np.full((len(windows), table.shape[2]), -np.inf, dtype=np.float32)
            where = np.zeros(best.shape, dtype=np.int32)
            for at in range(windows.shape[1] - width + 1):
                response = joint[codes[:, at]]
                if width == 3:
                    response += table[2][windows[:, at + 2]]
                elif width == 4:
                    response += tail[codes[:, at + 2]]
                if want_places:
                    better = response > best
                    where[better] = at
                np.maximum(best, response, out=best)
            parts.append(best)
            places[width] = where
        return np.maximum(np.concatenate(parts, axis=1) + self.bias, 0), places

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax over the languages for every window."""
        return softmax(self.pooled(windows)[0] @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(raw: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes of each) of the texts raw[offsets[i]:offsets[i + 1]]."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][text] + number * size
    used = np.minimum(size, offsets[1:][text] - start)
    places = start[:, None] + np.arange(size)[None, :]
    filled = np.arange(size)[None, :] < used[:, None]
    return np.where(filled, raw[np.minimum(places, max(len(raw) - 1, 0))], 0).astype(np.uint8), text, used


def train(texts: list[str], labels: list[str], per_text: int = WINDOWS, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network for the given labels; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    languages = sorted({label for text, label in zip(texts, labels) if text})
    windows, target = [], []
    for text, label in zip(texts, labels):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        if not len(raw):
            continue
        cut, _, _ = windows_of(raw, np.array([0, len(raw)]))
        cut = cut[rng.permutation(len(cut))[:per_text]]
        # windows of all lengths are met later: shorten some
        for row in cut[rng.random(len(cut)) < 0.3]:
            row[rng.integers(16, WINDOW) :] = 0
        windows.append(cut)
        target += [languages.index(label)] * len(cut)
    if not target:
        return Network({}, np.zeros(0), np.zeros((0, 0)), np.zeros(0), [])
    x, y = np.concatenate(windows), np.array(target)
    total = sum(WIDTHS.values())
    net = Network(
        {w: (rng.standard_normal((w, 256, n)) * 0.1).astype(np.float32) for w, n in WIDTHS.items()},
        np.zeros(total, dtype=np.float32), (rng.standard_normal((total, len(languages))) * 0.1).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32), languages,
    )
    # the same weight for every language, however many windows it has
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages))))[y].astype(np.float32)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            seen = x[rows]
            hidden, places = net.pooled(seen, want_places=True)
            error = softmax(hidden @ net.out + net.out_bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= weight[rows][:, None] / len(rows)
            back = (error @ net.out.T) * (hidden > 0)
            net.out -= rate * 4 * hidden.T @ error
            net.out_bias -= rate * error.sum(axis=0)
            net.bias -= rate * back.sum(axis=0)
            first = 0
            for width, n in WIDTHS.items():
                where, part = places[width], back[:, first : first + n]
                for k in range(width):
                    byte = np.take_along_axis(seen, where + k, axis=1)
                    np.add.at(net.filters[width][k], (byte, np.arange(n)[None, :]), -rate * len(rows) * part)
                first += n
    return net


def is_held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts that are not held out: at most ``per_language`` of each language."""
    usable = docs.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    classed = usable.select("doc_id", "lang", F.pmod(F.hash("doc_id"), F.lit(CLASSES)).alias("class"))
    rank = F.row_number().over(Window.partitionBy("lang", "class").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = classed.withColumn("n", rank).where(F.col("n") <= max(1, per_language // CLASSES))
    chosen = ranked.select("doc_id", "lang").distinct()
    # from each text the driver gets as many windows as it trains on, spread over the text
    step = F.greatest(F.lit(1), F.floor(F.length("text") / (WINDOWS * WINDOW))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring("text", k * step * WINDOW + 1, F.lit(WINDOW)))
    # the sample is bounded and ends on the driver; its ids may go to every task, so that no other text is moved
    rows = usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", F.concat_ws("", parts).alias("text"))
    got = sorted(tuple(r) for r in rows.toLocalIterator())
    return [t for _, _, t in got], [lang for _, lang, _ in got]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network:
    """Train on the labelled, not held-out rows of ``docs`` (doc_id, text, lang)."""
    return train(*training_rows(docs, per_language))


def predict(
    docs: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns ``keep`` with the language and its score, under ``names``, for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm.arrow import slices

        model = shared.value
        for batch in slices(batches, source, SLICE):
            texts = pc.fill_null(batch.column(source).cast(pa.large_string()), "")
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            known = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            if model.languages:
                total = np.zeros((len(texts), len(model.languages)))
                # a long text is cut into spans of whole windows that are scored in turn
                starts, ends = offsets[:-1], offsets[1:]
                span = STEP * WINDOW
                cuts = -(-(ends - starts) // span)
                owner = np.repeat(np.arange(len(texts)), cuts)
                first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * span
                last = np.minimum(first + span, ends[owner])
                sizes = -(-(last - first) // WINDOW)
                group = (np.cumsum(sizes) - 1) // STEP
                for g in np.unique(group):
                    rows = np.flatnonzero(group == g)
                    # the spans of a group follow each other in the buffer
                    bounds = np.append(first[rows], last[rows[-1]])
                    cut, at, used = windows_of(raw, bounds)
                    share = model.probabilities(cut) * used[:, None]
                    np.add.at(total, owner[rows][at], share)
                best = total.argmax(axis=1)
                score = total.max(axis=1) / np.maximum(total.sum(axis=1), 1)
            known &= bool(model.languages)
            labels = np.array([*model.languages, UNKNOWN], dtype=object)
            predicted = labels[np.where(known, best, len(labels) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(predicted, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))],
                names=[*keep, *names],
            )

    source = text if text in keep else "__text"  # a text that is kept is sent once
    rows = docs.select(*[docs[c] for c in keep], *([] if text in keep else [docs[text].alias("__text")]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


#: Documents whose language is less likely than this are rejected.
LEAST_SCORE = 0.3


def keep_known_languages(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents with letters whose language, by a network trained on them, is likely enough."""
    found = predict(docs, fit(docs), keep=tuple(docs.columns), names=("__lang", "__score"))
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).select(*docs.columns)
