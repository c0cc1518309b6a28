"""Exact token counts of every prefix of a text by dynamic programming.

A sequence of tokens is the byte-pair encoding of its text exactly if every two
neighbours are: merging the symbols of both gives the two tokens again.  So the
last token of every prefix is found from the last tokens of shorter prefixes,
and ``count[i] = count[i - len(last)] + 1``.  The vocabulary marks the end of a
word, so each prefix has two states: the word may go on (``open``) or ends here
(``closed``); only closed counts are reported, because a text cut there ends
the word.  Words that share their first letters share those states.

Results for odd input: a null text is an empty text; rows that repeat are
counted each; null ids are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import unicodedata
from pyspark.sql import DataFrame

from loomgraph.llm.arrow import grouped_sums, slices, spread, strings, text_of
from loomgraph.llm.tokens import WORD_BPE

#: Words, pieces and token pairs that a worker keeps before it starts anew.
CAPACITY = 600_000
BUDGET = 2048
#: A rank that no merge has.
NEVER = 1 << 30
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def lower(text: str) -> str:
    """Lower case of every character by itself (a last sigma is like any other)."""
    return text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])


class PrefixCounter:
    """Counts for all prefixes of words; the vocabulary comes from a tokenizer file."""

    def __init__(self, name: str = WORD_BPE, capacity: int = CAPACITY) -> None:
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            data = json.load(file)
        self.vocab: dict[str, int] = data["model"]["vocab"]
        self.end: str = data["model"]["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.halves = {a + b: (a, b, i) for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in data["added_tokens"]]
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.between = regex.compile("|".join(regex.escape(s) for s in self.special))
        self.opens = {t for t in self.vocab if not t.endswith(self.end) or t == self.end}
        self.closes = {t.removesuffix(self.end): t for t in self.vocab if t.endswith(self.end) and t != self.end}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(printable))
        self.letter = {b: 256 + i for i, b in enumerate(rest)}
        self.capacity = capacity
        self.fits: dict[tuple[str, str], bool] = {}
        self.closed_counts: dict[str, bytes | list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.deltas = np.zeros(1 << 16, dtype=np.int8)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)
        self.totals = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def symbols(self, token: str) -> list[str]:
        """The single-letter symbols of a token, the last with the word end if it has one."""
        if token not in self.opens:
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Byte-pair encoding of a few symbols: the best-ranked pair first, leftmost of equals."""
        while len(parts) > 1:
            best, at = min((self.rank.get(pair, NEVER), i) for i, pair in enumerate(itertools.pairwise(parts)))
            if best == NEVER:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    @functools.cache  # noqa: B019  (one counter per worker, one entry per token)
    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts that lie at one side of a token (1: right, 0: left), each with the rank of the merge that ends it."""
        out, ended = [], NEVER
        while token:
            out.append((token, ended))
            half = self.halves.get(token)
            token, ended = (half[side], half[2]) if half else ("", NEVER)
        return out

    @functools.cache  # noqa: B019
    def whole(self, token: str) -> bool:
        """Whether a token's own letters encode to it."""
        return self.merged(self.symbols(token)) == [token]

    def follows(self, before: str, token: str) -> bool:
        """Whether ``token`` may stand after ``before`` (empty: at the start of a word).

        It may not if some part at the end of ``before`` and some part at the start
        of ``token`` merge while both are there; of equal ranks the left one is first.
        """
        if not before:
            return self.whole(token)
        known = self.fits.get((before, token))
        if known is None:
            rank, left = self.rank, self.edge(token, 0)
            known = self.whole(token) and not any(
                rank.get((x, y), NEVER) < x_ends and rank[x, y] <= y_ends for x, x_ends in self.edge(before, 1) for y, y_ends in left
            )
            if len(self.fits) >= self.capacity:
                self.fits.clear()
            self.fits[before, token] = known
        return known

    def count_pieces(self, pieces: list[str]) -> None:
        """Closed counts after every byte of new pieces, in letters of the byte alphabet."""
        opens, closes, fits, follows = self.opens, self.closes, self.fits, self.follows
        last, opened, closed, before = [""], [0], [0], ""
        for piece in sorted(pieces):
            shared = 0
            for a, b in zip(before, piece):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], opened[shared + 1 :], closed[shared + 1 :]
            for stop in range(shared + 1, len(piece) + 1):
                parts = [(start, piece[start:stop]) for start in range(max(0, stop - self.longest), stop)]
                for start, part in parts:
                    if part in closes:
                        token, previous = closes[part], last[start]
                        known = fits.get((previous, token))
                        if follows(previous, token) if known is None else known:
                            closed.append(opened[start] + 1)
                            break
                for start, part in parts:
                    if part in opens:
                        previous = last[start]
                        known = fits.get((previous, part))
                        if follows(previous, part) if known is None else known:
                            last.append(part)
                            opened.append(opened[start] + 1)
                            break
            self.closed_counts[piece] = bytes(closed[1:]) if len(piece) < 256 else closed[1:]
            before = piece

    def letters(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letter)

    def pieces_of(self, text: str) -> list[tuple[int, str, str]]:
        """(start, text, byte letters) of the pieces of a normalised word."""
        return [(m.start(), p := m.group(), self.letters(p)) for m in self.pieces.finditer(text)]

    def of_plain(self, raw: str, pieces: list[tuple[int, str, str]] | None = None) -> list[int] | bytes:
        """Counts after every character of a text in composed form without special strings."""
        text = lower(raw)
        if pieces is None:
            pieces = self.pieces_of(text)
            self.count_pieces([p for _, _, p in pieces if p not in self.closed_counts])
        out: list[int] = []
        total = 0
        for start, piece, coded in pieces:
            if start > len(out):
                out += [total] * (start - len(out))
            closed = self.closed_counts[coded]
            if len(coded) == len(piece):
                counts = closed
            else:
                counts, used = [], -1
                for c in piece:
                    used += len(c.encode())
                    counts.append(closed[used])
            if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
                # cut after its first letter this is no contraction but two words
                apart = [self.letters(piece[0]), self.letters(piece[1])]
                self.count_pieces([p for p in apart if p not in self.closed_counts])
                counts = [counts[0], sum(self.closed_counts[p][-1] for p in apart), counts[2]]
            if not total and not out and len(pieces) == 1 and len(counts) == len(raw):
                return counts
            out += [total + c for c in counts] if total else counts
            total += closed[-1]
        out += [total] * (len(text) - len(out))
        if len(text) > len(raw):  # a few characters become two when lower-cased
            stops = itertools.accumulate(len(c.lower()) for c in raw)
            out = [out[k - 1] for k in stops]
        return out

    def of_composed(self, raw: str) -> list[int] | bytes:
        """Counts after every character of a word without special strings."""
        if unicodedata.is_normalized("NFC", raw):
            return self.of_plain(raw)
        # composing can change the characters before a cut, so each prefix is composed on its own
        return [self.of_plain(unicodedata.normalize("NFC", raw[:k]))[-1] for k in range(1, len(raw) + 1)]

    def of_word(self, raw: str) -> list[int]:
        """Counts after every character of a word, special strings included."""
        out, base, at = [], 0, 0
        for m in self.between.finditer(raw):
            counts = self.of_composed(raw[at : m.end() - 1])  # the special string is ordinary text until it is whole
            out += [base + c for c in counts]
            base += (counts[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + c for c in self.of_composed(raw[at:])]

    def _learn(self, words: list[str]) -> None:
        if len(self.closed_counts) > self.capacity:
            self.closed_counts.clear()
        known, parsed, new = self.closed_counts, [], set()
        for word in words:
            simple = (word.isascii() or unicodedata.is_normalized("NFC", word)) and "<|" not in word
            pieces = self.pieces_of(lower(word)) if simple else None
            parsed.append(pieces)
            if simple:
                new.update([p for _, _, p in pieces if p not in known])
        self.count_pieces(list(new))
        counts = [self.of_word(w) if p is None else self.of_plain(w, p) for w, p in zip(words, parsed)]
        sizes = np.fromiter(map(len, counts), dtype=np.int64, count=len(counts))
        flat = np.fromiter(itertools.chain.from_iterable(counts), dtype=np.int64, count=int(sizes.sum()))
        firsts = np.cumsum(sizes) - sizes
        deltas = np.diff(flat, prepend=0)
        filled = sizes > 0
        deltas[firsts[filled]] = flat[firsts[filled]]
        have, stop = len(self.place), len(self.place) + len(words)
        while stop > len(self.starts):
            self.starts, self.lengths, self.totals = (np.resize(x, 2 * len(x)) for x in (self.starts, self.lengths, self.totals))
        while self.used + len(flat) > len(self.deltas):
            self.deltas = np.resize(self.deltas, 2 * len(self.deltas))
        self.deltas[self.used : self.used + len(flat)] = deltas
        self.starts[have:stop], self.lengths[have:stop] = self.used + firsts, sizes
        self.totals[have:stop] = [c[-1] if c else 0 for c in counts]
        self.used += len(flat)
        self.place.update(zip(words, range(have, stop)))

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text its tokens; change of the count at every character of all texts; characters per text."""
        words = pc.ascii_split_whitespace(texts)
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        names = strings(coded.dictionary)
        if len(self.place) + len(names) > self.capacity:
            self.clear()
        place = self.place
        if new := [w for w in names if w not in place]:
            self._learn(new)
        local = np.fromiter((place[w] for w in names), dtype=np.int64, count=len(names))
        at = local[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, dtype=np.int64)
        n_tokens = grouped_sums(self.totals[at], ends)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        heads = (raw & 0xC0) != 0x80
        inked = ~SPACES[raw[heads]]
        changes = np.zeros(len(inked), dtype=np.int8)
        changes[inked] = self.deltas[spread(self.starts[at], self.lengths[at])]
        return n_tokens, changes, grouped_sums(heads, offsets[1:] - offsets[0])


@functools.cache
def counter(name: str = WORD_BPE) -> PrefixCounter:
    """The counter of this Python worker."""
    return PrefixCounter(name)


def prefix_counts(docs: DataFrame, name: str = WORD_BPE, budget: int = BUDGET, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_chars, n_tokens, fit_chars, changes).

    ``changes`` has one signed byte per character: how the token count changes
    when the text is cut after it instead of before it.  Running sums give the
    exact count of every prefix, see ``tokens_of_prefix`` and ``longest_prefix``.
    ``fit_chars`` is the length of the longest prefix of at most ``budget`` tokens.
    """
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(name)
        for batch in slices(batches):
            texts = text_of(batch)
            n_tokens, changes, sizes = counts.count(texts)
            ends = np.cumsum(sizes)
            fit = np.fromiter(
                (longest_prefix(changes[e - n : e], budget) if t > budget else n for e, n, t in zip(ends, sizes, n_tokens)),
                dtype=np.int64, count=len(sizes),
            )
            table = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(changes)],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(sizes), pa.array(n_tokens), pa.array(fit), table.cast(pa.binary())],
                names=["doc_id", "n_bytes", "n_chars", "n_tokens", "fit_chars", "changes"],
            )

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_chars long, n_tokens long, fit_chars long, changes binary")


def tokens_of_prefix(changes: bytes | np.ndarray, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters, without encoding them."""
    return int(np.frombuffer(changes, dtype=np.int8)[:n_chars].sum(dtype=np.int64))


def longest_prefix(changes: bytes | np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(changes, dtype=np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0
