"""Suffix stripping after M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980.

A plain version, one word at a time, that the columns of the library are compared with.
"""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiou"

# Suffix pairs of steps 2 and 3 and suffixes of step 4 in the published paper.
_STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al",
    entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al",
    iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP_4 = tuple(
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _shape(word: str) -> str:
    """One letter for each character: ``v`` vowel or ``c`` consonant (``y`` after a consonant: v)."""
    shape = ""
    for i, char in enumerate(word):
        vowel = char in _VOWELS or (char == "y" and i > 0 and shape[i - 1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _ends_cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _plural(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def _past_and_gerund(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = "ed" if word.endswith("ed") else "ing" if word.endswith("ing") else ""
    stem = word[: len(word) - len(suffix)]
    if not suffix or "v" not in _shape(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _ends_double(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replace(word: str, table: dict[str, str]) -> str:
    suffix = _longest(word, table)
    if suffix is None:
        return word
    stem = word[: len(word) - len(suffix)]
    return stem + table[suffix] if _measure(stem) > 0 else word


def _drop(word: str) -> str:
    suffix = _longest(word, _STEP_4)
    if suffix is None:
        return word
    stem = word[: len(word) - len(suffix)]
    if _measure(stem) < 2 or (suffix == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        count = _measure(stem)
        if count > 1 or (count == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=65536)
def porter_stem(word: str) -> str:
    """Stem of one lower-cased word; words of one or two letters stay as they are."""
    if len(word) < 3:
        return word
    word = _past_and_gerund(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP_2), _STEP_3)
    return _tidy(_drop(word))
