"""Token ids of whole texts, encoded once per distinct word.

The vocabulary's normaliser and splitter never look across white space, so the
ids of a text are the ids of its space-separated words one after another; nor
do they join a letter or digit with the mark after it, and capitals count as
small letters.  A Python worker keeps the words it has met, at most ``CAPACITY``
of them, and asks the library only for what is new in them; the ids are those of
the library on the text.
"""

from __future__ import annotations

import functools
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers

from loomgraph.llm.arrow import grouped_sums, spread, strings

WORD_BPE = "word_bpe_49k.json"
#: The id that ends a document.
END_ID = 1
#: Words kept by a worker before it starts anew (about 120 MB).
CAPACITY = 500_000
#: Stands between the words of one request; a word that contains it is asked alone.
MARK = "\x01"
#: Marks of which a run at the end of a word, after a letter or digit, is a piece of its own.
CLOSING = string.punctuation
IS_CLOSING = np.isin(np.arange(256), list(CLOSING.encode()))


#: Small letters for the bytes A to Z; all other bytes as they are.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def ascii_lower(texts: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets, A to Z in small letters."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(SMALL[raw]))


def pieces(words: pa.Array) -> pa.Array:
    """Two strings for each word with 64-bit offsets: the word without a closing run of marks, and that run.

    The second one is empty if there is no such run behind a letter or digit.
    """
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    # where the last byte that is no mark ends
    inner = np.concatenate(([0], np.maximum.accumulate(np.where(IS_CLOSING[raw], 0, np.arange(1, len(raw) + 1)))))[ends]
    closed = (inner > starts) & (inner < ends)
    if closed.any():
        closed[pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)] = False

    def cut() -> pa.Array:
        bounds = np.append(np.stack((starts, np.where(closed, inner, ends)), axis=1).ravel(), len(raw))
        return pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(bounds), pa.py_buffer(raw))

    at = np.flatnonzero(closed)
    if len(at):
        last = pc.utf8_slice_codeunits(cut().take(pa.array(2 * at)), -1).dictionary_encode()
        good = np.array([c.isalnum() for c in last.dictionary.to_pylist()], dtype=bool)
        closed[at] = good[last.indices.to_numpy(zero_copy_only=False)]
    return cut()


class WordEncoder:
    """Ids of texts from one vocabulary file."""

    def __init__(self, name: str = WORD_BPE, capacity: int = CAPACITY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.capacity = capacity
        self.mark_id = self.library.encode(MARK, add_special_tokens=False).ids[0]
        self.ends_word = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends_word[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint16)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _room(self, entries: int, ids: int) -> None:
        while len(self.place) + entries > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + ids > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))

    def _add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep words with their ids, one after another."""
        self._room(len(names), len(ids))
        have, new = len(self.place), len(self.place) + len(names)
        self.lengths[have:new] = lengths
        self.starts[have:new] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(names, range(have, new)))

    def _batch(self, words: list[str], between: str) -> np.ndarray:
        """Ids of words with something between them, many words per call of the library."""
        joined = [between.join(words[i : i + 256]) + between for i in range(0, len(words), 256)]
        found = [np.array(e.ids, dtype=np.int64) for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def _ask(self, words: list[str]) -> None:
        """Encode new words: those of letters end where a token ends a word, others at the mark between them."""
        letters = [w for w in words if w.isalpha()]
        ids = self._batch(letters, " ")
        stops = np.flatnonzero(self.ends_word[ids])
        if len(stops) == len(letters):
            self._add(letters, ids, np.diff(stops, prepend=-1))
        else:  # not all of them are letters to the library
            letters = []
        rest = set(words).difference(letters)
        plain = [w for w in rest if MARK not in w]
        ids = self._batch(plain, f" {MARK} ")
        marks = ids == self.mark_id
        self._add(plain, ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1)
        for word in rest.difference(plain):
            ids = self.library.encode(word, add_special_tokens=False).ids
            self._add([word], np.array(ids, dtype=np.int64), np.array([len(ids)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special strings count as they are written
            texts = ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        parts = pieces(coded.dictionary).dictionary_encode()
        names = strings(parts.dictionary)
        if len(self.place) + len(names) > self.capacity:
            self.clear()
        missing = [w for w in names if w not in self.place]
        if missing:
            self._ask(missing)
        local = np.fromiter(map(self.place.__getitem__, names), dtype=np.int64, count=len(names))
        pairs = local[parts.indices.to_numpy(zero_copy_only=False)].reshape(-1, 2)
        at = pairs[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        lengths = self.lengths[at]
        return self.ids[spread(self.starts[at], lengths)], grouped_sums(lengths, 2 * ends)


@functools.cache
def encoder(name: str = WORD_BPE) -> WordEncoder:
    """The encoder of this Python worker."""
    return WordEncoder(name)


def encode_documents(texts: pa.Array, name: str = WORD_BPE, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after every document: (ids uint32, where each document ends)."""
    ids, lengths = encoder(name).encode(texts)
    stops = np.cumsum(lengths)
    return np.insert(ids.astype(np.uint32), stops, end_id), stops + np.arange(1, len(stops) + 1)
