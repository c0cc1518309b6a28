"""Token output, packing and prefix counts against the library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from loomgraph.llm import arrow, grammar, packing, prefix_counts, tokens

ODD = [
    "", "a b <|endoftext|>c <|ENDOFTEXT|>", "x<|endoftext|>y<|startoftext|>", "<|endoftext|", "\x01", "a\x01 b", "é İ Σ ÀÉ", "x" * 300, "  \n ",
    "don't we'll 'RE !'re it's''ll 'l", "\x1c\x1d", "éá ok", "日本語 テスト", "12345 3kg", "😀😀!!", "A. B, c! 9. ². x.. .", "a b　c",
]
SCHEMA = "doc_id long, text string, changes string, sequence string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.WORD_BPE))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["Thing", "of", "blethe", "Énou", "ciónes.", "xx!!", "42", "don't"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(30)] + ["of the thing " * 6000]
    rows = [(i, t, "c", "s") for i, t in enumerate(texts)] + [(900, None, None, None), (None, "no id", None, None), (3, texts[3], "c", "s"), (3, texts[3], "c", "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library(library):
    small = tokens.WordEncoder(capacity=8)
    for text in ODD:
        for encoder in (small, tokens.encoder()):
            ids, lengths = encoder.encode(pa.array([text], pa.large_string()))
            assert ids.tolist() == ids_of(library, text) and lengths.tolist() == [len(ids)], text


def test_every_prefix_count(library):
    counts = prefix_counts.PrefixCounter(capacity=50)
    for text in ODD:
        total, changes, sizes = counts.count(pa.array([text], pa.large_string()))
        assert sizes.tolist() == [len(text)] and total.tolist() == [len(ids_of(library, text))]
        for k in range(len(text) + 1):
            assert prefix_counts.tokens_of_prefix(changes, k) == len(ids_of(library, text[:k])), (text, k)


def test_prefix_table(spark, docs, library):
    rows = prefix_counts.prefix_counts(docs, budget=20).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for row in rows:
        text = row.text or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(ids_of(library, text)))
        fits = [k for k in range(len(text) + 1) if prefix_counts.tokens_of_prefix(row.changes, k) <= 20]
        assert row.fit_chars == max(fits)
    assert prefix_counts.prefix_counts(docs).count() == docs.count()
    assert prefix_counts.prefix_counts(docs.limit(0)).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for n, high in ((0, 5), (1, 5), (50, 2), (5000, 3), (20000, 30)):
        ids = rng.integers(0, high, n).astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, n, n // 40), n)) if n > 1 else np.arange(1, n + 1)
        symbols, starts, base, rules = grammar.compress(ids, ends)
        expanded = grammar.expansion_lengths(base, rules)
        assert (grammar.expand(symbols, base, rules, expanded) == ids).all()
        row = {
            "rules": rules.astype("<u2").tobytes(), "expanded": expanded.astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes(),
            "base": base, "starts": starts.tolist(), "n_tokens": np.diff(np.concatenate(([0], ends))).astype(int).tolist(),
        }
        for d in range(0, len(ends), 7):  # any document on its own
            assert grammar.decode(row, [d])[0].tolist() == ids[ends[d] - row["n_tokens"][d] : ends[d]].tolist()
    assert len(symbols) < len(ids)


def test_token_files(spark, docs, library, tmp_path):
    path = f"{tmp_path}/shards"
    grammar.write_shards(docs, path, block=2000)
    rows = sorted(grammar.read_documents(spark, path).collect(), key=lambda r: r.start)
    want = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
    assert [r.doc_id for r in rows] == [r.doc_id for r in want]
    start = 0
    for row, doc in zip(rows, want):
        ids = np.array([*ids_of(library, doc.text), 1], dtype="<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    grammar.write_shards(docs.limit(0), f"{tmp_path}/none")
    assert grammar.read_documents(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("shard", [7, 20_000])
def test_packing(spark, docs, library, shard):
    rows = packing.pack(packing.pieces(docs, capacity=64), capacity=64, shard=shard).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(library, d.text)) + 1 for d in docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    text = {d.doc_id: d.text for d in docs.collect()}
    for r in rows:
        ids = np.array([*ids_of(library, text[r.doc_id]), 1], dtype="<u4")
        assert r.start == 64 * r.piece and r.length == min(64, len(ids) - r.start)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
    assert len(by) <= -(-sum(r.length for r in rows) // 64) + 3
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_place_follows_the_sum_of_squares():
    rng, capacity = random.Random(2), 12
    sizes = [rng.randrange(1, capacity) for _ in range(200)]
    sequence, offset = packing.place(np.array(sizes), capacity)
    gaps = {}
    for size, number, start in zip(sizes, sequence.tolist(), offset.tolist()):
        def total(change):
            after = {**gaps, **change}
            return sum(sum(1 for g in after.values() if g == k) ** 2 for k in range(1, capacity))

        best = min([total({n: g - size}) for n, g in gaps.items() if g >= size] + [total({len(gaps): capacity - size})])
        assert start == capacity - gaps.get(number, capacity) and total({number: gaps.get(number, capacity) - size}) == best
        gaps[number] = gaps.get(number, capacity) - size


def test_words_with_closing_marks_are_kept_once():
    """A word's marks are cut off before it is looked up, so that a word is kept and asked for once, whatever follows it."""
    encoder = tokens.WordEncoder()
    texts = ["abc abc. abc, abc!? É?? x<|. ²$$ $$$ $a,", "", " .", None]
    ids, lengths = encoder.encode(arrow.text_of(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])))
    want = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for found in want for i in found] and lengths.tolist() == [len(found) for found in want]
    assert "abc" in encoder.place and not {"abc.", "abc,", "abc!?"} & set(encoder.place)
