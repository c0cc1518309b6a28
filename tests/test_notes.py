"""Note store, search and text index, also against one-by-one simulations."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import porter, text
from loomgraph.operators import knowledge as kn
from loomgraph.operators import search as se
from loomgraph.operators import textindex as ti

T0 = datetime(2024, 1, 1)
LONG = "A sentence that is long enough to be stored as the content of a note, number "


def store_rows(spark, rows):
    return spark.createDataFrame(
        [(f"r{i:03}", T0 + timedelta(seconds=i), t, c, tags, scope) for i, (t, c, tags, scope) in enumerate(rows)],
        schemas.STORE_REQUEST,
    )


def empty(spark):
    return spark.createDataFrame([], schemas.KNOWLEDGE)


def test_validation_messages(spark):
    rows = [
        ("Title good enough", LONG, ["ok-1"], "global"),
        ("  short ", LONG, [], "repo:x"),
        ("", "", ["bad tag"], "team:x"),
        ("é" * 51, "todo " + LONG, [str(i) for i in range(11)], "PROJECT:A_b-1"),
        ("Title good enough", "TODO", [], ""),
    ]
    got = {r.req_id: r.errors for r in store_rows(spark, rows).withColumn("errors", kn.store_errors()).collect()}
    assert got["r000"] == []
    assert got["r001"] == ["title must be at least 10 characters"]
    assert got["r002"] == [
        "title is required", "content is required", 'invalid tag "bad tag": tags must be alphanumeric with hyphens',
        'invalid scope: must be "global", "project:<name>", or "repo:<name>"',
    ]
    assert got["r003"] == [
        "title must be at most 100 characters",
        "content appears too generic; provide specific, actionable knowledge",
        "maximum 10 tags allowed",
    ]
    assert got["r004"] == [
        "content must be at least 50 characters",
        "content appears too generic; provide specific, actionable knowledge",
    ]


def sequential_store(rows, titles=None, contents=None):
    titles, contents, out = dict(titles or {}), dict(contents or {}), []
    for i, (t, c, _, scope) in enumerate(rows):
        tk, ck = (scope, t.lower()), (scope, c)
        if tk in titles:
            out.append(("title", titles[tk]))
        elif ck in contents:
            out.append(("content", contents[ck]))
        else:
            titles[tk] = contents[ck] = f"r{i:03}"
            out.append((None, None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_store_batch_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [
        (f"Note title {rng.randrange(12)}", f"{LONG}{rng.randrange(12)}", [], rng.choice(["global", "repo:a"]))
        for _ in range(80)
    ]
    outcome, added = kn.store_batch(empty(spark), store_rows(spark, rows))
    got = {r.req_id: (r.field, r.existing_id) for r in outcome.collect()}
    want = sequential_store(rows)
    assert [got[f"r{i:03}"] for i in range(len(rows))] == want
    assert {r.id for r in added.collect()} == {f"r{i:03}" for i, w in enumerate(want) if w[0] is None}


def chain_rows(n):
    """Each note shares its title with one neighbour and its content with the other."""
    order = list(range(n))
    random.Random(n).shuffle(order)
    return [(f"Note title {(i + 1) // 2}", f"{LONG}{i // 2}", [], "global") for i in order]


@pytest.mark.parametrize("together", [50_000, 100, 7])
def test_chains_take_few_writes(spark, monkeypatch, together):
    """In one task, by connected groups, and round by round: the same notes, and no more writes for a longer chain unless by rounds."""
    monkeypatch.setattr(kn, "TOGETHER", together)
    writes, write = [], kn.materialize
    monkeypatch.setattr(kn, "materialize", lambda df, name: (writes.append(name), write(df, name))[1])
    rows = chain_rows(1000) if together == 50_000 else chain_rows(60) + [(f"Other {t}", c, g, s) for t, c, g, s in chain_rows(200)]
    got = {r.req_id: r.code for r in kn.store_batch(empty(spark), store_rows(spark, rows))[0].collect()}
    want = sequential_store(rows)
    assert [got[f"r{i:03}"] == "OK" for i in range(len(rows))] == [w[0] is None for w in want]
    if together == 50_000:
        assert len(writes) <= 8


def test_store_against_existing_notes(spark):
    _, existing = kn.store_batch(empty(spark), store_rows(spark, [("Note title one", LONG + "1", ["B", "b"], "")]))
    assert [(r.id, r.tags, r.scope) for r in existing.collect()] == [("r000", ["b"], "global")]
    later = store_rows(spark, [
        ("NOTE  title one", LONG + "2", [], "global"), ("Another title", LONG + "1", [], ""), ("Another title", LONG + "1", [], "repo:z"),
    ]).withColumn("req_id", F.concat(F.lit("n"), "req_id"))
    got = {r.req_id: (r.code, r.field, r.existing_id) for r in kn.store_batch(existing, later)[0].collect()}
    assert got == {
        "nr000": ("DUPLICATE_KNOWLEDGE", "title", "r000"), "nr001": ("DUPLICATE_KNOWLEDGE", "content", "r000"), "nr002": ("OK", None, None),
    }


def notes_table(spark, rows):
    """(title number, content number, scope) rows as stored notes."""
    return kn.as_notes(
        spark.createDataFrame(
            [(f"k{i}", T0, f"Note title {t}", f"{LONG}{c}", ["a"], s) for i, (t, c, s) in enumerate(rows)],
            schemas.STORE_REQUEST,
        )
    )


def patches(spark, rows):
    return spark.createDataFrame(
        [(f"p{i:03}", T0 + timedelta(seconds=i + 1), *r) for i, r in enumerate(rows)], schemas.UPDATE_REQUEST
    )


def rounds_of(monkeypatch):
    """How often a round of the update loop has been written."""
    seen, write = [], kn.materialize
    monkeypatch.setattr(kn, "materialize", lambda df, name: (seen.append(name), write(df, name))[1])
    return lambda: seen.count("judged-patches")


@pytest.mark.parametrize("claimants", [3, 12])
def test_claimants_of_one_title_take_a_fixed_number_of_rounds(spark, monkeypatch, claimants):
    rounds = rounds_of(monkeypatch)
    base = notes_table(spark, [(i, i, "global") for i in range(claimants)])
    outcome, _ = kn.update_batch(base, patches(spark, [(f"k{i}", "The same new title", None, None, False, None) for i in range(claimants)]))
    codes = [r.code for r in outcome.orderBy("req_id").collect()]
    assert codes == ["OK"] + ["DUPLICATE_KNOWLEDGE"] * (claimants - 1) and rounds() <= 2


def test_a_rejected_patch_does_not_undo_an_earlier_one(spark):
    base = notes_table(spark, [(1, 1, "global"), (2, 2, "global")])
    outcome, after = kn.update_batch(base, patches(spark, [("k0", "A fine new title", None, None, False, None), ("k0", None, LONG + "2", None, False, None)]))
    assert {r.req_id: (r.code, r.field) for r in outcome.collect()} == {"p000": ("OK", None), "p001": ("DUPLICATE_KNOWLEDGE", "content")}
    assert after.where("id = 'k0'").first().title == "A fine new title"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_update_batch_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    base = [(i, i, rng.choice(["global", "repo:a"])) for i in range(15)]
    ids = [rng.randrange(18) for _ in range(24)]  # several patches of one note among them
    asked = []
    for i in ids:
        kind = rng.randrange(3)
        asked.append((
            f"k{i}",
            f"Note title {rng.randrange(15)}" if kind != 1 else None,
            f"{LONG}{rng.randrange(15)}" if kind == 1 else None,
            None, False, rng.choice([None, "global", "repo:a"]),
        ))
    outcome, table = kn.update_batch(notes_table(spark, base), patches(spark, asked))
    state = {f"k{i}": [f"Note title {t}", f"{LONG}{c}", s] for i, (t, c, s) in enumerate(base)}
    want = {}
    for n, (key, title, content, _, _, scope) in enumerate(asked):
        if key not in state:
            want[f"p{n:03}"] = ("NOT_FOUND", None, None)
            continue
        new = [title or state[key][0], content or state[key][1], scope or state[key][2]]
        hit = (None, None)
        for field, at in (("title", 0), ("content", 1)):
            other = [k for k, v in state.items() if k != key and v[at] == new[at] and v[2] == new[2]]
            if other and hit[0] is None:
                hit = (field, other[0])
        want[f"p{n:03}"] = ("OK" if hit[0] is None else "DUPLICATE_KNOWLEDGE", *hit)
        if hit[0] is None:
            state[key] = new
    assert {r.req_id: (r.code, r.field, r.existing_id) for r in outcome.collect()} == want
    assert {r.id: [r.title, r.content, r.scope] for r in table.collect()} == state


def test_patches_of_one_note_are_folded(spark):
    table = notes_table(spark, [(1, 1, "global")])
    rows = patches(spark, [
        ("k0", "Note title two", None, None, False, None),
        ("k0", None, LONG + "two", None, False, None),
        ("k0", "Note title three", None, [], True, None),
        ("k0", "short", None, None, False, None),
        (" ", None, None, None, False, None),
    ])
    outcome, after = kn.update_batch(table, rows)
    note = after.first()
    assert (note.title, note.content, note.tags) == ("Note title three", LONG + "two", [])
    codes = {r.req_id: (r.code, r.errors) for r in outcome.collect()}
    assert codes["p003"] == ("VALIDATION_ERROR", ["title must be at least 10 characters"])
    assert codes["p004"] == (
        "VALIDATION_ERROR", ["id is required", "at least one of title, content, tags, or scope must be provided"],
    )
    assert kn.outcome_envelope(outcome).where("result.code = 'OK'").count() == 3


# --- text functions ---------------------------------------------------------------

def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalisation(spark):
    assert one(spark, text.normalize_title(F.lit("  A  b\tC\n"))) == "a b c"
    assert one(spark, text.normalize_content(F.lit(" a\r\n\r\n\r\n\rb\r "))) == "a\n\nb"
    assert one(spark, text.normalize_tags(F.array(F.lit(" A"), F.lit(""), F.lit("a"), F.lit("B ")))) == ["a", "b"]
    assert one(spark, text.normalize_scope(F.lit(" "))) == "global"
    assert one(spark, text.tags_from_json(F.lit("{bad"))) == []
    assert one(spark, text.round_score(F.lit(-1.2345))) == pytest.approx(-1.235)


def test_stemmer():
    words = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
        "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
        "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adoption": "adopt",
        "controll": "control", "rate": "rate", "cease": "ceas", "is": "is",
    }
    assert {w: porter.stem(w) for w in words} == words


# --- search --------------------------------------------------------------------------

def test_query_parsing(spark):
    rows = [
        (1, "foo-bar AND (baz)"), (2, 'say "hi there"'), (3, "a_b"), (4, "not android"), (5, "what?"), (6, '"" "'), (7, "***"),
    ]
    df = spark.createDataFrame(rows, "query_id long, query string")
    terms = {}
    for r in se.query_terms(df).collect():
        terms.setdefault(r.query_id, []).append((r.term_no, r.words, r.is_prefix))
    terms = {k: [t[1:] for t in sorted(v)] for k, v in terms.items()}
    assert terms[1] == [(["foo"], True), (["bar"], True), (["baz"], True)]
    assert terms[2] == [(["say"], True), (["hi"], True), (["there"], False)]
    assert terms[3] == [(["a", "b"], True)]
    assert terms[4] == [(["android"], True)]
    assert 6 not in terms and 7 not in terms
    valid = {r.query_id: r.v for r in df.select("query_id", se.is_valid_expression("query").alias("v")).collect()}
    assert not valid[5] and all(valid[k] for k in (1, 2, 3, 4, 6, 7))
    assert one(spark, se.match_expression(F.lit("a-b or c"))) == "a* b* c*"


def library(spark):
    rows = [
        ("n1", "Connection pooling", "Always reuse database connections through the pool", ["db", "perf"], "global", 1),
        ("n2", "Retry policy", "Retries use exponential delays; database calls are retried", ["db"], "repo:a", 2),
        ("n3", "Naming", "Functions are named after what they return", ["style"], "repo:b", 3),
    ]
    return spark.createDataFrame(
        rows, "id string, title string, content string, tags array<string>, scope string, at long"
    ).withColumn("created_at", F.timestamp_seconds("at"))


def requests(spark, *rows):
    return spark.createDataFrame(rows, schemas.SEARCH_REQUEST)


def test_search_end_to_end(spark):
    got = {}
    for r in se.search(library(spark), requests(
        spark,
        (1, "database retry", [], "", 0), (2, "databases", ["DB", "perf", "perf"], "repo:b", 5), (3, "???", [], "repo:b", 2),
        (4, "ab", [], "", 5), (5, "data", [], "", -1), (6, "style", [], None, 1), (7, "connections reus", [], "", 5),
    )).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    got = {k: [x[1] for x in sorted(v)] for k, v in got.items()}
    assert got[1] == ["n2"]
    assert got[2] == ["n1"]
    assert got[3] == ["n3", "n1"] or got[3] == ["n1", "n3"]
    assert 4 not in got and 5 not in got
    assert got[6] == ["n3"] and got[7] == ["n1"]


def test_boosts(spark):
    rows = [("x", 2.0, ["DB", "perf"], ["db", "db", "other"], "repo:a", "repo:a"), ("y", 2.0, [], ["db"], "global", "repo:a"), ("z", 2.0, ["db"], None, "repo:b", "")]
    df = spark.createDataFrame(rows, "id string, bm25 double, tags array<string>, context_tags array<string>, scope string, query_scope string")
    assert {r.id: r.score for r in se.rerank(df).collect()} == {"x": 2.9, "y": 2.2, "z": 2.0}


def test_index_update_equals_rebuild(spark):
    rows = library(spark)
    fields = {"title": "title", "content": "content"}
    changed = rows.where("id = 'n2'").withColumn("content", F.lit("Something else entirely"))
    updated = ti.update_index(ti.build_index(rows, "id", fields, stem=True), changed, rows.where("id = 'n3'"), "id", fields)
    rebuilt = ti.build_index(rows.where("id = 'n1'").unionByName(changed), "id", fields, stem=True)
    assert sorted(map(str, updated.postings.collect())) == sorted(map(str, rebuilt.postings.collect()))
    assert sorted(updated.docs.collect()) == sorted(rebuilt.docs.collect())


def test_many_updates_of_a_stored_index(spark):
    """Random edits: words by content as in a rebuild, few segments, a search that reads by word; new words only are stemmed."""
    rng, fields = random.Random(4), {"title": "title", "content": "content"}
    words = [f"{w}{s}" for w in ("run", "index", "not", "cat", "sing") for s in ("", "s", "ing", "ed", "er")]

    def text():
        return " ".join(rng.choices(words, k=rng.randint(0, 12)))

    def frame(rows):
        return spark.createDataFrame([(i, *r) for i, r in rows.items()], "id string, title string, content string")

    rows = {f"d{i}": (text(), text()) for i in range(40)}
    index = ti.build_index(frame(rows), "id", fields, stem=True, stored=True)
    for step in range(4):
        edits = {f"d{rng.randrange(50)}": (text(), text() + f" brandnew{step}") for _ in range(3)}
        gone = rng.sample(sorted(rows), 2)
        index = ti.update_index(index, frame(edits), frame({g: ("", "") for g in gone if g not in edits}), "id", fields)
        rows = {i: r for i, r in {**rows, **edits}.items() if i not in gone or i in edits}
        assert len(index.segments) <= 3
    rebuilt = ti.build_index(frame(rows), "id", fields, stem=True)
    assert sorted(map(str, index.postings.collect())) == sorted(map(str, rebuilt.postings.collect()))
    assert sorted(index.docs.collect()) == sorted(rebuilt.docs.collect())
    known = [tuple(r) for r in index.vocabulary.collect()]
    assert len(known) == len(set(known)) and dict(known).items() >= {tuple(r) for r in rebuilt.vocabulary.collect()}
    terms = spark.createDataFrame([(1, 0, ["running"], False), (1, 1, ["ind"], True)], "query_id long, term_no int, words array<string>, is_prefix boolean")
    weights = {"title": 2.0, "content": 1.0}
    assert sorted(ti.bm25(index, terms, weights).collect()) == sorted(ti.bm25(rebuilt, terms, weights).collect())
    wanted = spark.createDataFrame([("runs",)], "token string")
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,runs)" in index.occurrences(wanted)._jdf.queryExecution().toString()


@pytest.mark.parametrize(("words", "ranges"), [(1000, 200), (3, 200), (3, 2)])
def test_words_are_pushed_as_literals_or_ranges(spark, monkeypatch, words, ranges):
    monkeypatch.setattr(ti, "PUSHED_WORDS", words)
    monkeypatch.setattr(ti, "PUSHED_RANGES", ranges)
    tokens = ["ab", "abc", "b", "zz", "é", "日本", "a"]
    df = spark.createDataFrame([(w,) for w in [*tokens, "m", "aa", "zzz"]], "token string")
    chosen = ti.word_filter(df.where(F.col("token").isin(*tokens)))
    got = {r.token for r in df.where(chosen).collect()}
    assert set(tokens) <= got and (words > 3) == (got == set(tokens))


def test_stemmed_search_is_search_over_stems(spark):
    """The stemmed search of whole documents, computed a second way: search without stemming over stemmed texts."""
    import re

    def stemmed(text):
        return re.sub(r"\w+", lambda m: porter.stem(m.group().lower()), text or "")

    folder = "/root/testdata/sf0.001"
    if os.path.isdir(folder):
        docs = spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'en'").collect()
        rows = [(str(d.doc_id), d.text.split("\n")[0][:100], d.text, [d.lang, d.source], "global", d.doc_id) for d in docs]
    else:
        rows = [tuple(r)[:6] for r in library(spark).collect()]
    schema = "id string, title string, content string, tags array<string>, scope string, at long"
    asked = [(1, "thing ertions", [], "", 8), (2, "edonre heated", ["en"], "", 5), (3, "attion", [], "", 20)]

    def found(rows, asked, stem):
        notes = spark.createDataFrame(rows, schema).withColumn("created_at", F.timestamp_seconds("at"))
        got = se.search(notes, requests(spark, *asked), se.index_notes(notes, stem).stored())
        return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in got.collect())

    plain = [(i, stemmed(t), stemmed(c), [stemmed(x) for x in tags], s, a) for i, t, c, tags, s, a in rows]
    want = found(plain, [(q, " ".join(porter.stem(w) for w in text.split()), tags, s, n) for q, text, tags, s, n in asked], False)
    got = found(rows, asked, True)
    assert [r[:3] for r in got] == [r[:3] for r in want] and want


def test_one_batch_of_searches_sorts_no_postings(spark, monkeypatch):
    """A search without an index gives what a stored one gives, and stores the words of texts only."""
    notes, asked = library(spark), requests(spark, (1, "retri", [], "", 5), (2, "con pool", ["db"], "", 5))
    want = se.search(notes, asked, se.index_notes(notes, stored=True)).collect()
    written = []
    monkeypatch.setattr(ti, "materialize", lambda df, name, keep=ti.materialize: written.append(name) or keep(df, name))
    assert sorted(se.search(notes, asked).collect()) == sorted(want)
    assert "index-texts" in written and "postings" not in written


def test_tokens_of_plain_and_other_texts(spark):
    rows = spark.createDataFrame([("Plain OLD-text 42_x",), ("\u00c9t\u00e9 e\u0301 \u00df9-\ue000",), ("",), (None,)], "x string")
    got = [r.t for r in rows.select(ti.tokens("x").alias("t")).collect()]
    assert got == [["plain", "old", "text", "42", "x"], ["ete", "e", "\u00df9", "\ue000"], [], []]


def test_a_word_skips_the_branches_of_ranges_around_it(spark):
    ranges = [(f"{c}b", f"{c}d") for c in "acegikmoqsuwy"]
    words = spark.createDataFrame([(f"{c}{d}",) for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcde"], "w string")
    got = {r.w for r in words.where(ti._within(F.col("w"), ranges)).collect()}
    assert got == {r.w for r in words.collect() if any(low <= r.w <= high for low, high in ranges)}


def test_a_merging_update_writes_its_words_once(spark, monkeypatch):
    """Texts without words, repeated and accented ones, two fields: the same words as without tables, and one table of postings."""
    texts = [("a", "b a  b b", "Été b"), ("b", "", None), ("c", None, "x"), ("d", "?!", "b x b")]
    rows, fields = spark.createDataFrame(texts, "id string, title string, content string"), {"title": "title", "content": "content"}
    index = ti.build_index(rows, "id", fields, stored=True)
    assert sorted(index.postings.collect()) == sorted(ti.build_index(rows, "id", fields).postings.collect())
    assert index.segments[0].size == 10 and index.segments[0].packed.count() == 7
    written = []
    monkeypatch.setattr(ti, "materialize", lambda df, name, keep=ti.materialize: written.append(name) or keep(df, name))
    changed = rows.where("id = 'a'").withColumn("title", F.lit("new b"))
    index = ti.update_index(index, changed, rows.where("id = 'c'"), "id", fields)
    want = ti.build_index(changed.unionByName(rows.where("id IN ('b', 'd')")), "id", fields)
    assert sorted(index.postings.collect()) == sorted(want.postings.collect()) and sorted(index.docs.collect()) == sorted(want.docs.collect())
    assert len(index.segments) == 1 and written.count("postings") == 1
