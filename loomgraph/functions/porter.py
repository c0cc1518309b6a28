"""Porter's suffix-stripping algorithm (M. F. Porter, "An algorithm for suffix stripping", 1980).

A word-level helper; the text index applies it to word lists, each distinct word of an Arrow batch once.
"""

from __future__ import annotations

import re

# The suffix tables of steps 2, 3 and 4 of the paper.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
)

_SHAPE_VOWELS = re.compile(r"[aeiou]")


def _shape(word: str) -> str:
    """Letters as v (vowel) or c (consonant); y is a vowel after a consonant."""
    out = []
    for i, letter in enumerate(word):
        if _SHAPE_VOWELS.match(letter):
            out.append("v")
        elif letter == "y" and i > 0 and out[-1] == "c":
            out.append("v")
        else:
            out.append("c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """Stem of one lower-case word; words of one or two letters, or with other than a-z, stay."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z]+", word):
        return word
    # step 1a
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # step 1b
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        ending = _longest(word, ("ed", "ing"))
        if ending and _has_vowel(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double_consonant(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    # step 1c
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    # steps 2 and 3
    for table in (STEP2, STEP3):
        ending = _longest(word, table)
        if ending and _measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + table[ending]
    # step 4
    ending = _longest(word, STEP4)
    if ending:
        rest = word[: -len(ending)]
        if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
            word = rest
    # step 5
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
