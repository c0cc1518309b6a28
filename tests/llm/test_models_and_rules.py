"""Language, toxicity, licence and decontamination operators on small tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import language, licenses, templates, toxicity

SYLLABLES = {"en": ["the", "ing", "ou", "th", "sh"], "fr": ["é", "eau", "oi", "que", "ment"], "de": ["ung", "sch", "keit", "ü", "der"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(20, 200)), lang, "src", i) for i in range(300)]
    rows += [(1000, None, "en", None, None), (1001, "", "fr", None, None), (1002, "12 !?", "de", None, None), (1003, prose(rng, "de", 60_000), None, None, None)]
    rows += [(5, rows[5][1], rows[5][2], "src", 5), (None, rows[6][1], rows[6][2], None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred int").cache()


def test_language(corpus):
    net = language.fit(corpus)
    assert net.languages == sorted(SYLLABLES)
    rows = language.predict(corpus, net).collect()
    assert len(rows) == corpus.count()
    truth = {r.doc_id: r.lang for r in corpus.collect()}
    for r in rows:
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id == 1003:
            assert r.lang_pred == "de" and 0 < r.score <= 1
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    kept = language.keep_known_languages(corpus)
    assert kept.columns == corpus.columns and {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())
    none = corpus.limit(0)
    assert language.predict(none, language.fit(none)).count() == 0


def test_windows_hold_every_byte():
    rng = np.random.default_rng(0)
    raw = rng.integers(1, 255, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 1, 256, 513, 513, 3000, 5000])
    cut, text, used = language.windows_of(raw, offsets)
    for i in range(len(offsets) - 1):
        mine = np.concatenate([np.zeros(0, np.uint8), *[w[:n] for w, t, n in zip(cut, text, used) if t == i]])
        assert (mine == raw[offsets[i] : offsets[i + 1]]).all()
    assert all((w[n:] == 0).all() for w, n in zip(cut, used))


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["grumpo", "grumpish", "vexel"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(rng, rng.choice(list(SYLLABLES)), 60).split(), i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic), 1))
    rows += [(1000, None, None), (1001, "", None), (1002, "... !", None), (1003, "grumpo " + prose(rng, "en", 20), None), (None, "vexel", None), (3, rows[3][1], 0.5)]
    labels += [(5, 0, 1), (None, 1, 1), (1001, None, 1), (7, None, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    shipped = toxicity.score(docs, marks).collect()
    assert len(shipped) == len(rows) and all(0 <= r.score <= 1 for r in shipped)
    truth = {i: i % 5 == 0 for i in range(600)}
    held = [r for r in shipped if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in shipped}
    assert by[1000].score == by[1001].score == by[1002].score < 0.5 <= by[1003].score
    joined = {r.doc_id: r.score for r in toxicity.score(docs, marks, most=0).collect()}
    assert all(abs(joined[i] - r.score) < 1e-9 for i, r in by.items())
    assert toxicity.score(docs.limit(0), marks.limit(0)).count() == 0
    assert all(r.score < 0.5 for r in toxicity.score(docs, marks.limit(0)).collect())


def test_log_ratios_by_hand(spark):
    words = spark.createDataFrame([("ab", 3, 1), ("ac", 2, 0), ("b", 0, 5)], "word string, ordinary long, toxic long")
    got = {r.key: r.ratio for r in toxicity.log_ratios(words, 2).collect()}
    top = {}
    for w, o, t in (("ab", 3, 1), ("ac", 2, 0), ("b", 0, 5)):
        s = "^" + w + "$"
        for i in range(len(w) + 1):
            a, b = top.get(s[i : i + 2], (0, 0))
            top[s[i : i + 2]] = (a + o, b + t)
    d, k = toxicity.DISCOUNT, toxicity.SHARED
    kinds = {}
    for g in top:
        kinds[g[1]] = kinds.get(g[1], 0) + 1
    total = sum(kinds.values())
    low = {c: (n - d) / total + d * len(kinds) / total / (len(kinds) + 1) for c, n in kinds.items()}
    for g, (o, t) in top.items():
        same = [v for h, v in top.items() if h[0] == g[0]]
        n = sum(a + b for a, b in same)
        p = (o + t - d + d * len(same) * low[g[1]]) / n
        side = [(max(own - d, 0) + (d * sum(v[c] > 0 for v in same) + k) * p) / (sum(v[c] for v in same) + k) for c, own in ((0, o), (1, t))]
        assert got[g] == pytest.approx(np.log(side[1] / side[0]))


def test_licences(spark):
    s = licenses.SENTENCES
    mit = f"Copyright (c) X\n\n{s['mit-grant']}:\n\n{s['mit-notice']}.\n\n{s['mit-as-is']}. {s['mit-liability']}."
    wrapped = mit.replace(" of ", "\n// of ")
    swapped = f"{s['gpl3-terms']}. {s['gpl-free']}: something else."
    rows = [
        (1, mit), (2, wrapped), (3, swapped), (4, f"{s['gpl-free']}: {s['gpl3-terms']}. Text between. {s['gpl-hope']};"), (5, None), (6, ""), (7, "no licence here"),
        (8, "Some line\nReleased under the MIT License.\nmore. All rights reserved."), (8, "Some line\nReleased under the MIT License.\nmore. All rights reserved."),
        (9, "# SPDX-License-Identifier: Apache-2.0\n" + "word " * 50_000), (10, "MIT. SPDX-License-Identifier"), (None, "Licensed under CC BY 4.0!"),
    ]
    docs = spark.createDataFrame([(i, t, "L", 0) for i, t in rows], "doc_id long, text string, license string, row int").repartition(3)
    got = sorted(((r.doc_id or 0, r.license, r.n_sentences) for r in licenses.licenses(docs).collect()))
    assert got == [
        (0, "CC-BY-4.0", 1), (1, "MIT", 4), (2, "MIT", 4), (4, "GPL-3.0", 2), (8, "MIT", 1), (8, "MIT", 1),
        (8, "all rights reserved", 1), (8, "all rights reserved", 1), (9, "Apache-2.0", 2),
    ]
    assert licenses.licenses(docs.limit(0)).count() == 0
    plan = licenses.licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
    for rule in licenses.RULES:
        assert any(h in s[rule[1][0]].lower() for h in licenses.HINTS)


ITEM = "Yesterday Tom bought 12 apples for 3 dollars and gave 12 of them to Anna in Paris before he went home."


def test_templates(spark):
    said = "Yesterday {} bought {} apples for {} {} and gave {} of them to {} in {} before he went home."
    rows = [
        (1, "Intro text. " + said.format("Bob", "17", "9", "euros", "17", "Lucy", "Berlin") + " More."),
        (2, "Intro. " + said.format("Bob", "17", "9", "euros", "18", "Lucy", "Berlin")), (3, ITEM), (3, ITEM), (4, None), (5, ""),
        (6, "see the quick brown fox jumps over"), (7, "nothing at all of the kind we look for today or tomorrow, Tom"), (None, "the quick brown fox jumps"),
        (8, "word " * 50_000 + ITEM), (9, "12 13 14 15 16 17 18 19 20 Tom Anna"),
    ]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, coverage double").repartition(3)
    items = [(1, ITEM), (11, ITEM), (2, "short one"), (3, None), (4, "the quick brown fox jumps"), (5, ""), (6, "1 2 3 4 5 6 7 8 9")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in templates.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 1), (8, 1), (6, 4), (None, 4)}
    assert got[1, 1].slots_changed and not got[3, 1].slots_changed
    kept = templates.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7, 9]
    assert templates.matches(docs.limit(0), bench).count() == templates.matches(docs, bench.limit(0)).count() == 0


def test_templates_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["of", "the", "Rome", "7", "km", "gave", "it", "Ann", "run", "41"]
    benches = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 15)))) for i in range(20)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=30)) + " " + (rng.choice(benches)[1] if i % 3 == 0 else "") + " " + " ".join(rng.choices(vocabulary, k=9))) for i in range(60)]

    def template(text):
        out = []
        for n, w in enumerate(text.split()):
            kind = "#" if w.isdigit() else "u" if w == "km" else "N" if w[0].isupper() and n else None
            out.append((kind or w.lower(), w.lower() if kind else None))
        return out

    def spans(t, size):
        return [(p, t[p : p + size]) for p in range(len(t) - size + 1) if sum(v is None for _, v in t[p : p + size]) >= templates.SHORTEST]

    want = set()
    for d, text in docs:
        mine = template(text)
        for b, question in benches:
            theirs = template(question)
            size = min(len(theirs), templates.WINDOW)
            wins = spans(theirs, size)
            if not wins:
                continue
            hits = [(q, p - q, [(x[1], y[1]) for x, y in zip(w, v) if x[1]]) for q, w in wins for p, v in spans(mine, size) if [x[0] for x in w] == [y[0] for y in v]]
            good = set()
            for q, shift, slots in hits:
                values = {}
                for _, s, pairs in hits:
                    if s == shift:
                        for a, f in pairs:
                            values.setdefault(a, set()).add(f)
                if all(len(values[a]) == 1 for a, _ in slots):
                    good.add(q)
            if len(good) / len(wins) >= templates.COVERAGE:
                want.add((d, b))
    texts = {}
    for b, question in benches:
        texts.setdefault(question, b)
    want = {(d, b) for d, b in want if texts[dict(benches)[b]] == b}
    got = templates.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benches, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    assert got.where(F.col("coverage") > 1).count() == 0
