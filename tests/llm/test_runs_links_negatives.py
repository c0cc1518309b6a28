"""Periodic runs, HyperMinHash links and R-tree negatives against brute force."""

import hashlib
import itertools
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import hyperminhash, periodic, queries, rtree


def brute_runs(words, least=6, times=4):
    """(start, length, period) of the maximal stretches of every period that is their smallest."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(least, times * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = set(itertools.chain(*(range(s + q, s + n) for s, n, q in runs)))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_many_texts(seed):
    rng = random.Random(seed)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 5)):
            words = []
            for _ in range(rng.randint(0, 9)):
                base = rng.choices("abcdefgh"[: rng.choice([1, 2, 3, 8])], k=rng.randint(1, 9))
                words += (base * 7)[: rng.randint(1, 60)]
            docs.append(words)
        texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t ", "\x0b"]).join(w) + rng.choice(["", " "]) for w in docs]
        found = periodic.runs_of(*periodic.coded(pa.array(texts, pa.large_string())))
        assert [found.get(i, []) for i in range(len(docs))] == [brute_runs(w) for w in docs]


def test_long_and_nested_periods():
    inner = [*"ab" * 5, "c"]
    words = inner * 6 + [str(i % 700) for i in range(5000)] + ["z"] * 40_000
    found = periodic.runs_of(*periodic.coded(pa.array([" ".join(words)], pa.large_string())))
    assert found[0] == sorted([(11 * k, 10, 2) for k in range(6)] + [(0, 66, 11), (66, 5000, 700), (5066, 40_000, 1)], key=lambda r: (r[0], r[2]))


def test_periodic_runs_of_a_table(spark):
    texts = [None, "", " \n ", "a", "Ha ha ha ha ha ha", "ha " * 7, "x y " * 6 + "x y", "one two " * 4 + "three", "ab\x1cab " * 5]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(5, texts[5], "r", 1), (None, texts[5], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(rows) and periodic.periodic_runs(docs.limit(0)).count() == 0
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        runs = brute_runs(words)
        want.append((i, len(words), runs, collapsed([w.decode() for w in words], runs)))
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got), key=str) == sorted(want, key=str)


def test_op13_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.choice([0, 1, 7, 80, 300]))) if i % 9 else None) for i in range(400)] + [(None, "q " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    import zlib

    rewritten = 0
    for i, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, rewritten = words[:a] + [words[a + (k - a) % p] for k in range(a, n)], rewritten + 1
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), collapsed(words, runs))]
        assert got[i] == (i, len(runs), *head, *sums)
    assert rewritten > 20 and len(got) == len(rows)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute_components(sets, threshold=85):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= threshold * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("most", [4096, 7])
def test_hyperminhash_components(spark, monkeypatch, most):
    rng = random.Random(most)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t", "One", "one", "ONE two", "a b", "À b c", "à b c", "x " * 30_000, "x x x"]
    for size in (6, 9, 20, 60, 400):
        for _ in range(3):
            base = rng.choices(vocabulary, k=size)
            for _ in range(12):
                words = list(base)
                for _ in range(rng.randint(0, max(1, size // 30))):
                    words[rng.randrange(size)] = rng.choice(vocabulary)
                texts.append(rng.choice([" ", "\n "]).join(words + rng.choices(vocabulary, k=rng.choice([0, 0, 1]))))
    texts += [" ".join(rng.choices(vocabulary, k=60)) for _ in range(60)]
    # a chain, whose ends are not similar
    chain = rng.choices(vocabulary, k=100)
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 20, 3)]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(9, texts[9], "s", 1), (None, texts[4], "s", 1), (None, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set string, kept int").repartition(3)
    monkeypatch.setattr(hyperminhash, "MOST", most)
    monkeypatch.setattr(hyperminhash, "MOST_SHINGLES", 500 * most)
    got = hyperminhash.near_duplicates(docs).collect()
    sets = [shingles(t) for t in texts]
    roots = brute_components(sets)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), roots[r.doc_id], roots[r.doc_id] == r.doc_id)
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles) == [(3, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None and not r.n_shingles] == [(None, True)]
    assert len(set(roots)) < len(texts) - 60
    assert hyperminhash.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for size, shared in ((2000, 0.85), (2000, 0.5), (300, 0.7), (40, 0.85), (2000, 0.0)):
        got = []
        for _ in range(60):
            common = int(round(2 * size * shared / (1 + shared)))
            pool = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
            a, b = pool[:size], np.concatenate((pool[:common], pool[size:]))
            x, y = hyperminhash.registers(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            got.append(float(hyperminhash.estimate(np.array((x == y).sum()), np.array(len(a)), np.array(len(b)))))
        assert abs(np.mean(got) - common / (2 * size - common)) < 0.04, (size, shared, np.mean(got))


def brute_negatives(rows, positives=5, negatives=3, low=50, high=95):
    good = [
        (i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, label, a in sorted({(i, label, tuple(v)) for i, label, v in good if i % 50 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in good if j != i and len(b) == len(a))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [(-s, k) for s, k, other in scored if other != label and low * -p <= 100 * -s <= high * -p]
            out += [(i, j, rank, k, -p, s) for rank, (s, k) in enumerate(hard[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("dims", [1, 2, 17])
def test_rtree_hard_negatives(spark, monkeypatch, dims):
    rng = np.random.default_rng(dims)
    centres = rng.standard_normal((6, dims))
    rows = [(int(i), int(i) % 5, [float(np.float32(x)) for x in (centres[i % 6] + rng.standard_normal(dims) / 2).round(2)]) for i in rng.permutation(900)]
    rows += [(1001 + i, i % 3, rows[0][2]) for i in range(200)]  # a common vector
    rows += [(1300, None, rows[1][2]), (1350, 1, None), (None, 1, rows[2][2]), (1400, 1, [float("inf")] + [0.0] * (dims - 1)), (1401, 1, [None] * dims)]
    rows += [(1450 + i, i % 2, [1.0] * (dims + 1)) for i in range(8)] + [rows[3], (1450, 7, [1.0] * (dims + 1))]
    frame = spark.createDataFrame([(i, label, v, 1) for i, label, v in rows], "vec_id long, label int, embedding array<float>, slot int")
    monkeypatch.setattr(rtree, "BLOCK_ROWS", 150)
    monkeypatch.setattr(rtree, "CHUNK", 5)
    got = rtree.hard_negatives(frame, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)
    assert rtree.hard_negatives(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_search_prunes_and_is_exact():
    rng = np.random.default_rng(5)
    label = rng.integers(0, 4, 5000)
    vectors = rng.integers(-9, 10, (5000, 3)) + 300 * rng.integers(0, 5, (5000, 1))
    rows = rtree.pack([label, *vectors.T])
    ids, label, vectors = rng.permutation(5000)[rows], label[rows], vectors[rows]
    tree = rtree.Tree(ids, label, vectors)
    assert tree.children[tree.root][1] == tree.root and len(tree.children) == len(tree.low)
    queries = rng.integers(-50, 50, (20, 3))
    lower, upper = tree.intervals(queries)
    visited = 0
    for i, query in enumerate(queries):
        scores = vectors @ query
        for least, most in ((-(1 << 60), 1 << 60), (int(scores.max()) // 2, int(scores.max()) * 3 // 4)):
            seen = []

            rows = rtree._leaf_rows(tree, query, label != 2, least, most)

            def of(leaf, rows=rows, seen=seen):
                seen.append(leaf)
                return rows(leaf)

            suits = ((upper[i] >= least) & (lower[i] <= most)).tolist()
            got = tree.best(of, upper[i].tolist(), suits, 7, least, most)
            want = sorted((-int(s), int(j)) for s, j, x in zip(scores, ids, label) if x != 2 and least <= s <= most)[:7]
            assert got == [(-s, j) for s, j in want]
            visited += len(seen)
    assert visited < 0.6 * 40 * tree.leaves
