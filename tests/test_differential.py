"""Edges after a change, derived where something changed, against all edges derived anew."""

import random

import pytest

from loomgraph.operators import differential, rules

SYMBOL = "id long, repo_id long, file_id long, lang string, kind string, name string, fqn string"
CALL = "id long, repo_id long, file_id long, caller long, callee_text string"
REF = "repo_id long, file_id long, src long, dst long, ref_text string, confidence double, provenance string"


def world(rng, files):
    """Symbols, calls and refs by file: types with methods of few names, so that sets, super types and calls meet often."""
    symbols, calls, refs = {}, [], []

    def symbol(repo, file, lang, kind, name, fqn):
        key = (repo, kind, fqn)
        symbols.setdefault(key, (hash(key) % 10**12, repo, file, lang, kind, name, fqn))
        return symbols[key][0]

    for file, seed in files.items():
        local, repo = random.Random(seed), file % 2
        lang = ("go", "java", "javascript", "typescript")[file // 2 % 4]
        pkg = {"go": "m/a", "java": "com.a", "javascript": "src/a", "typescript": "app/a"}[lang] + str(file // 8)
        here = [symbol(repo, file, lang, "package", pkg.split(".")[-1], pkg)] if lang in ("go", "java") else []
        for t in local.sample("ABCDE", 3):
            kinds = {"go": ("type", "interface"), "java": ("class", "interface"), "javascript": ("class",), "typescript": ("class", "interface", "enum")}[lang]
            owner = symbol(repo, file, lang, local.choice(kinds), t, f"{pkg}.{t}")
            here.append(owner)
            for m in local.sample("uvwx", local.randint(1, 3)):
                fqn = {"go": f"{pkg}.({t}).{m}", "java": f"{pkg}.{t}#{m}():int"}.get(lang, f"{pkg}.{t}.{m}")
                here.append(symbol(repo, file, lang, local.choice(("method", "method", "function")), m, fqn))
            for provenance in ("extends-heuristic", "implements-heuristic") if lang == "java" else ():
                refs.append((repo, file, owner, None, local.choice("ABCDE"), 0.5, provenance))
            refs.append((repo, file, owner, None, local.choice((f"{pkg}.A", "B", "a1.C", "com.a0.D", "m/a0.E")), 0.4, "type-ref"))
            refs.append((repo, file, here[0], None, local.choice(("m/a0", "m/a1", "com.a0", "com.a1")), 0.8, "extractor"))
        for n in range(4):
            calls.append((file * 100 + n, repo, file, local.choice([*here, None]), local.choice(("u", "x.v", "a.w", "A", "x"))))
    rows = list(symbols.values())
    known = {r[0] for r in rows}
    # the merged symbol of a key belongs to one of its files; callers and sources are ids that exist
    return rows, [c if c[3] in known else (*c[:3], None, c[4]) for c in calls], [r for r in refs if r[2] in known]


def frames(spark, rows):
    return {name: spark.createDataFrame(r, schema) for name, r, schema in zip(("symbols", "callsites", "refs"), rows, (SYMBOL, CALL, REF))}


def as_set(edges):
    return {(r.repo_id, r.kind, r.src, r.dst, r.confidence, r.provenance) for r in edges.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_changed_edges_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    files = {f: rng.random() for f in range(16)}
    before = frames(spark, world(rng, files))
    changed = rng.sample(sorted(files), 3)
    after_files = {**files, **{f: rng.random() for f in changed[:2]}, 16 + seed: rng.random()}
    after_files.pop(changed[2])
    after = frames(spark, world(rng, after_files))
    touched_files = spark.createDataFrame([(f,) for f in (*changed, 16 + seed)], "file_id long")
    old = rules.build_edges(before["symbols"], before["callsites"], before["refs"], attribute=False)
    want = as_set(rules.build_edges(after["symbols"], after["callsites"], after["refs"], attribute=False))
    touched, fresh = differential.edge_changes(before, after, touched_files)
    kept = differential.untouched(old, touched)
    got = as_set(rules.union_rules([kept, fresh]))
    assert got == want
    assert {k for _, k, *_ in want} == set(differential.KINDS)
    # what did not change was not derived again
    assert as_set(kept) and len(as_set(fresh)) < len(want)


def test_nothing_changed_derives_nothing(spark):
    rows = frames(spark, world(random.Random(1), {f: f / 7 for f in range(8)}))
    touched, fresh = differential.edge_changes(rows, rows, spark.createDataFrame([], "file_id long"))
    assert touched.count() == 0 and fresh.count() == 0


def test_calls_between_changed_symbols_are_derived_once(spark):
    """Both ends of a call have changed: it comes from one side only, so that it needs no distinct."""
    rows = frames(spark, world(random.Random(1), {f: f / 7 for f in range(16)}))
    nothing = {name: table.where("false") for name, table in rows.items()}
    calls = differential.edge_changes(nothing, rows, spark.createDataFrame([(f,) for f in range(16)], "file_id long"))[1].where("kind = 'CALLS'")
    assert calls.count() == calls.distinct().count() == rules.call_edges(rows["symbols"], rows["callsites"]).count() > 0
