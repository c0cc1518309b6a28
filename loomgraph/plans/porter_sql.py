"""Porter's stemmer as SQL over a table of words, to check the stemmed search against."""

from __future__ import annotations

from loomgraph.functions.porter import STEP2, STEP3, STEP4


def shape(w: str) -> str:
    """Vowels as V, consonants as C; y is a vowel behind a consonant.  Four y in a row are the most that are told apart."""
    out = f"regexp_replace(regexp_replace(regexp_replace({w}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        out = f"replace(replace({out}, 'Cy', 'CV'), 'Vy', 'VC')"
    return out


def measured(n: str, least: int) -> str:
    """Whether the first letters (all but n) hold ``least`` vowel-consonant sequences; s is the word's shape."""
    return f"regexp_matches(left(s, len(w) - {n}), '{'VC+V+C' if least > 1 else 'VC'}')"


def suffixes(table: dict[str, str], least: int) -> str:
    """Replace the longest suffix of a table where the rest is long enough."""
    cases = " ".join(
        f"WHEN ends_with(w, '{x}') THEN CASE WHEN {measured(str(len(x)), least)}"
        + (" AND regexp_matches(w, '[st]ion$')" if x == "ion" else "")
        + f" THEN left(w, len(w) - {len(x)}) || '{table[x]}' ELSE w END"
        for x in sorted(table, key=len, reverse=True)
    )
    return f"CASE {cases} ELSE w END"


SHORT = "(right(s, 3) = 'CVC' AND NOT regexp_matches(w, '[wxy]$'))"
ONE = "(regexp_matches(s, 'VC') AND NOT regexp_matches(s, 'VC+V+C'))"
#: Expressions on w (the word so far) and s (its shape), one after another; ``cut`` marks words whose ed or ing has gone.
STEPS = (
    "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, len(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, len(w) - 1) ELSE w END",
    f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {measured('3', 1)} THEN left(w, len(w) - 1) ELSE w END "
    "WHEN ends_with(w, 'ed') AND contains(left(s, len(w) - 2), 'V') THEN left(w, len(w) - 2) || '+' "
    "WHEN ends_with(w, 'ing') AND contains(left(s, len(w) - 3), 'V') THEN left(w, len(w) - 3) || '+' ELSE w END",
    f"CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN len(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(s, 1) = 'C' AND NOT regexp_matches(w, '[lsz]$') "
    f"THEN left(w, len(w) - 1) WHEN NOT (len(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(s, 1) = 'C' AND NOT regexp_matches(w, '[lsz]$')) AND {ONE} AND {SHORT} THEN w || 'e' ELSE w END",
    "CASE WHEN ends_with(w, 'y') AND contains(left(s, len(w) - 1), 'V') THEN left(w, len(w) - 1) || 'i' ELSE w END",
    suffixes(STEP2, 1),
    suffixes(STEP3, 1),
    suffixes(dict.fromkeys(STEP4, ""), 2),
)


def porter_sql(words: str) -> str:
    """Common table expressions that end with stems(word, stem) of a relation ``words`` (word)."""
    parts = [f"p0 AS (SELECT word, w, false AS cut, {shape('w')} AS s FROM (SELECT DISTINCT word, word AS w FROM {words} WHERE len(word) > 2 AND regexp_full_match(word, '[a-z]+')) x)"]
    for i, step in enumerate(STEPS):
        parts.append(
            f"p{i + 1} AS (SELECT word, w, cut, {shape('w')} AS s FROM (SELECT word, replace(v, '+', '') AS w, contains(v, '+') AS cut FROM (SELECT word, {step} AS v FROM p{i}) y) x)"
        )
    n = len(STEPS)
    # the final e goes by the measure and end of what is in front of it
    front = f"SELECT word, w AS whole, left(w, len(w) - 1) AS w, left(s, len(w) - 1) AS s FROM p{n} WHERE ends_with(w, 'e')"
    bare = f"SELECT word, CASE WHEN regexp_matches(s, 'VC+V+C') OR ({ONE} AND NOT {SHORT}) THEN w ELSE whole END AS w FROM ({front}) f"
    parts.append(f"e0 AS ({bare} UNION ALL SELECT word, w FROM p{n} WHERE NOT ends_with(w, 'e'))")
    last = f"CASE WHEN ends_with(w, 'll') AND regexp_matches({shape('w')}, 'VC+V+C') THEN left(w, len(w) - 1) ELSE w END"
    parts.append(
        f"stems AS (SELECT word, {last} AS stem FROM e0 UNION ALL SELECT DISTINCT word, word FROM {words} WHERE len(word) <= 2 OR NOT regexp_full_match(word, '[a-z]+'))"
    )
    return ", ".join(parts)
