"""Bit-sliced search, SimHash groups, line runs and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import arrow, bitsliced, components, line_dedup, simhash


def brute_top(rows, k):
    """(query, rank, id, score) for (id, vector) rows."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(q, tuple(a)) for q, a in good if q % 50 == 0}):
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("dims", [0, 1, 5, 32])
def test_bit_sliced_top_k(spark, dims, monkeypatch):
    rng = np.random.default_rng(dims)
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(dims).round(1)]) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2050, [1.0] * (dims + 1)), (2051, [-2.0] * (dims + 1)), (None, rows[1][1]), (2100, [float("nan")] + [0.0] * dims), (2101, [None] + [0.0] * dims)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 128)
    monkeypatch.setattr(bitsliced, "CHUNK", 3)
    got = bitsliced.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5)
    assert bitsliced.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = [None, "", " \t ", "One", "one", "a b c", "A  B\nC", "À b c d e", "x " * 50_000]
    for k in range(60):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(400)] = f"z{k}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choices(base, k=80)) for _ in range(40)]
    rows = [(i, t, "f", 1) for i, t in enumerate(texts)] + [(9, texts[9], "f", 1), (None, texts[9], "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, keep int").repartition(4)
    monkeypatch.setattr(simhash, "MOST", 8)
    found = simhash.near_duplicates(docs).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert len(found) == len(rows)
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and root[b] < root[a]:
                    root[a], changed = root[b], True
    for r in found:
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == root[r.doc_id]
        else:
            assert r.component_id == root[9]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_anchors_cover_all_near_pairs():
    rng = np.random.default_rng(3)
    fps = rng.integers(-(1 << 63), (1 << 63) - 1, 200)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in fps], dtype=np.uint64).view(np.int64)
    other = fps ^ flips
    for x, y in zip(fps, other):
        a, _, home = simhash.anchors_of(np.array([x]))
        b, _, _ = simhash.anchors_of(np.array([y]))
        assert set(a[home]) & set(b)


def test_components_of_long_paths(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300)]
    rng.shuffle(edges)
    got = dict(components.components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(80)}}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_lines(rows, words):
    """{doc_id: (text, lines deleted)} for (doc_id, text) rows in document order."""
    wins, cut = [], []
    for k, (_, text) in enumerate(rows):
        lines = line_dedup.lines_of(text or "")
        sizes, plain = [len(x.split()) for x in lines], [x.strip() for x in lines]
        spans = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += sizes[b]
                if total >= words:
                    if sizes[a]:
                        spans.add((a, b))
                    break
        for b in range(len(lines)):
            total = 0
            for a in range(b, -1, -1):
                total += sizes[a]
                if total >= words:
                    if sizes[b] and sizes[a]:
                        spans.add((a, b))
                    break
        wins += [(k, a, b, tuple(plain[a : b + 1])) for a, b in spans]
        cut.append(lines)
    first, gone = {}, [set() for _ in rows]
    for k, a, _, content in sorted(wins):
        first.setdefault(content, (k, a))
    for k, a, b, content in wins:
        if (k, a) > first[content]:
            gone[k] |= set(range(a, b + 1))
    return {rows[k][0]: ("".join(x for n, x in enumerate(lines) if n not in gone[k]), len(gone[k])) for k, lines in enumerate(cut)}


@pytest.mark.parametrize("bits", [1 << 25, 8 * 32768])
def test_line_runs(spark, monkeypatch, bits):
    monkeypatch.setattr(arrow, "BITMAP_BITS", bits)
    rng = random.Random(3)
    pool = ["a b c. ", "d e f\n", "g. ", "h i\n", "\n", "j k l m n o p. ", "q! ", "r s t u v w x y z\n"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, "long. " * 3000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in [*rows, (300, None), (2, rows[2][1])]], "doc_id long, text string, runs int").repartition(3)
    got = line_dedup.dedup_lines(docs, 8).collect()
    want = brute_lines(rows, 8)
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r.text, r.removed_lines) == (want[r.doc_id] if r.doc_id != 300 else (None, 0))
    stage = line_dedup.drop_repeated_lines(docs, 8)
    assert stage.columns == docs.columns
    assert {r.doc_id for r in stage.collect()} == {i for i, (t, n) in want.items() if t.strip() or not n} | {300}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_join_to_the_text():
    for text in ("", "a", "a.\nb. c! d", "\n\n", "x. ", "1.5 is. a", "é.\t b\r\nc"):
        assert "".join(line_dedup.lines_of(text)) == text
