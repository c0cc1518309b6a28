"""Runs of words, wherever they begin and end, against brute force."""

import random

import pytest

from loomgraph.llm import arrow, line_dedup, word_runs


def brute_runs(rows, words):
    """{doc_id: words that stay} for (doc_id, text) rows in document order."""
    first, out = {}, {}
    for k, (i, text) in enumerate(rows):
        w = (text or "").split()
        gone = set()
        for a in range(len(w) - words + 1):
            if first.setdefault(tuple(w[a : a + words]), (k, a)) != (k, a):
                gone |= set(range(a, a + words))
        out[i] = [x for n, x in enumerate(w) if n not in gone]
    return out


@pytest.mark.parametrize("bits", [1 << 25, 8 * 32768])
def test_word_runs(spark, monkeypatch, bits):
    monkeypatch.setattr(arrow, "BITMAP_BITS", bits)
    rng = random.Random(7)
    rows = []
    for i in range(80):
        parts = [f"w{rng.randrange(60)}{rng.choice(['', '.', '।', '。'])}" for _ in range(rng.randint(0, 60))]
        if rows and i % 2:
            source = rng.choice(rows)[1].split()
            at = rng.randint(0, max(0, len(source) - 7))
            place = rng.randint(0, len(parts))
            parts[place:place] = source[at : at + rng.randint(5, 20)]
        rows.append((i, rng.choice(["", " \n"]) + "".join(p + rng.choice([" ", "  ", "\n", "\t"]) for p in parts)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, "long. " * 300), (201, "a b c " * 4), (202, "é ü ö " * 40)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in [*rows, (300, None), (2, rows[2][1])]], "doc_id long, text string, runs int").repartition(3)
    got = word_runs.dedup_runs(docs, 8, 4).collect()
    want = brute_runs(rows, 8)
    assert len(got) == len(rows) + 2
    before = dict(rows)
    for r in got:
        if r.doc_id == 300:
            assert r.text is None and r.removed_words == 0
            continue
        assert r.text.split() == want[r.doc_id]
        assert r.removed_words == len(before[r.doc_id].split()) - len(want[r.doc_id]) == sum(x.last - x.first + 1 for x in r.runs or [])
        assert r.removed_words or r.text == before[r.doc_id]
    assert sum(r.removed_words for r in got) > 500
    assert word_runs.dedup_runs(docs.limit(0)).count() == 0


def test_passage_in_mid_sentence(spark):
    passage = " ".join(f"p{n}" + "." * (n in (20, 40)) for n in range(53))  # 33 words are in whole sentences
    devanagari = " ".join(f"क{n}" + "।" * (n % 9 == 0) for n in range(80))
    rows = [(1, f"One two {passage} three four."), (2, f"Five six\nseven {passage} eight nine."), (3, f"x {devanagari} y"), (4, f"z {devanagari} q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in word_runs.dedup_runs(docs).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == [rows[0][1], "Five six\nseven eight nine.", rows[2][1], "z q"]
    assert [tuple(r) for r in got[2].runs] == [(3, 55, 1)] and got[2].removed_words == 53
    # the rule by lines leaves both
    assert all(r.removed_words == 0 for r in line_dedup.dedup_lines(docs).collect())


def test_words_are_hashed_and_runs_merged_without_python_objects(monkeypatch):
    """Both steps work on whole arrays: no call of a hash function for each word, no list of rows."""
    import numpy as np
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(word_runs.xxhash, "xxh64_intdigest", lambda w: calls.append(w) or len(calls))
    texts = pa.array(["b  a é", "", " a\nb", "ab", "x" * 300 + " a"], pa.large_string())
    hashes, text = word_runs.hashes_of(texts)
    assert not calls and text.tolist() == [0, 0, 0, 2, 2, 3, 4, 4]
    assert hashes[1] == hashes[3] == hashes[7] and hashes[0] == hashes[4] and len(np.unique(hashes)) == 5

    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("of_doc_id", pa.int64())]))
    rows = lambda *found: [dict(zip(("first", "last", "of_doc_id"), f)) for f in found]
    found = pa.array([rows((5, 9, 2), (0, 4, 1), (20, 30, 3), (22, 24, 4), (31, 33, None)), rows((7, 8, 5)), [], rows((7, 7, 6), (9, 9, None))], kind)
    want = [rows((0, 9, 1), (20, 33, 3)), rows((7, 8, 5)), [], rows((7, 7, 6), (9, 9, None))]
    assert word_runs.merge(found).to_pylist() == want
    assert word_runs.merge(found.slice(1, 3)).to_pylist() == want[1:] and word_runs.merge(found.slice(0, 0)).to_pylist() == []
