"""Suffix stripping after M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980, as columns.

Each step takes the word and its shape, a text with ``v`` for a vowel and ``c`` for a consonant at the place of each
character. A suffix is cut from both, so the measure of what is left is a pattern on a prefix of the shape: the
number of places where a consonant follows a vowel. The steps are texts of SQL, which become one expression at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix pairs of steps 2 and 3 and suffixes of step 4 in the published paper.
STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al",
    entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al",
    iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP_4 = tuple("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split())

def _bound(value: str, name: str, body: str) -> str:
    """``body`` with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def shape(word: str) -> str:
    """``v`` or ``c`` for each character; a ``y`` is a vowel after a consonant.

    The first of several ``y`` is a consonant at the start and after a vowel; from there they take turns.
    """
    letters = f"translate(regexp_replace({word}, '[^aeiouy]', 'c'), 'aeiou', 'vvvvv')"
    return f"translate(replace(regexp_replace({letters}, '(^|v)y', '$1c'), 'yy', 'vc'), 'y', 'v')"


def _cut(text: str, n) -> str:
    return f"left({text}, length({text}) - {n})"


def _some(shape: str) -> str:
    """A measure above 0."""
    return f"contains({shape}, 'vc')"


def _several(shape: str) -> str:
    """A measure above 1."""
    return f"rlike({shape}, 'vc.*vc')"


def _short_end(word: str, shape: str) -> str:
    """Consonant, vowel, consonant other than w, x and y."""
    return f"(endswith({shape}, 'cvc') AND NOT rlike({word}, '[wxy]$'))"


def _without(word: str, shape: str, n: str, body: str) -> str:
    """``body`` of what is left of word and shape, ``bare`` and ``rest``, when ``n`` characters go."""
    return _bound(_cut(word, n), "bare", _bound(_cut(shape, n), "rest", body))


def _longest(word: str, suffixes, body: str) -> str:
    """``body`` of the longest ``suffix`` that the word ends with, or an empty text: a pattern finds the one that begins first."""
    return _bound(f"regexp_extract({word}, '({'|'.join(suffixes)})$', 1)", "suffix", body)


def _plural(word: str, shape: str) -> str:
    return f"CASE WHEN rlike({word}, '(ss|i)es$') THEN {_cut(word, 2)} WHEN rlike({word}, '(^|[^s])s$') THEN {_cut(word, 1)} ELSE {word} END"


def _past_and_gerund(word: str, shape: str) -> str:
    mended = f"""CASE WHEN NOT contains(rest, 'v') THEN {word}
        WHEN rlike(bare, '(at|bl|iz)$') THEN concat(bare, 'e')
        WHEN rlike(bare, r'([^lsz])\\1$') AND endswith(rest, 'c') THEN {_cut("bare", 1)}
        WHEN {_some("rest")} AND NOT {_several("rest")} AND {_short_end("bare", "rest")} THEN concat(bare, 'e')
        ELSE bare END"""
    return f"""CASE WHEN endswith({word}, 'eed') THEN if({_some(_cut(shape, 3))}, {_cut(word, 1)}, {word})
        WHEN endswith({word}, 'ed') THEN {_without(word, shape, "2", mended)}
        WHEN endswith({word}, 'ing') THEN {_without(word, shape, "3", mended)} ELSE {word} END"""


def _last_y(word: str, shape: str) -> str:
    return f"if(endswith({word}, 'y') AND contains({_cut(shape, 1)}, 'v'), concat({_cut(word, 1)}, 'i'), {word})"


def _replaced(table: dict[str, str]):
    new = "CASE suffix " + " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in table.items()) + " END"

    def step(word: str, shape: str) -> str:
        change = f"suffix <> '' AND {_some(_cut(shape, 'length(suffix)'))}"
        return _longest(word, table, f"if({change}, concat({_cut(word, 'length(suffix)')}, {new}), {word})")

    return step


def _dropped(word: str, shape: str) -> str:
    drop = f"suffix <> '' AND {_several('rest')} AND (suffix <> 'ion' OR rlike(bare, '[st]$'))"
    return _longest(word, STEP_4, _without(word, shape, "length(suffix)", f"if({drop}, bare, {word})"))


def _last_e(word: str, shape: str) -> str:
    drop = f"{_several('rest')} OR ({_some('rest')} AND NOT {_short_end('bare', 'rest')})"
    return f"if(endswith({word}, 'e'), {_without(word, shape, '1', f'if({drop}, bare, {word})')}, {word})"


def _last_l(word: str, shape: str) -> str:
    return f"if(endswith({word}, 'll') AND {_several(shape)}, {_cut(word, 1)}, {word})"


# each step with what a word that it changes ends with: others skip the step, whose shape costs most
_STEPS = (
    ("s", _plural), ("ed|ing", _past_and_gerund), ("y", _last_y), ("|".join(STEP_2), _replaced(STEP_2)),
    ("|".join(STEP_3), _replaced(STEP_3)), ("|".join(STEP_4), _dropped), ("e", _last_e), ("ll", _last_l),
)


def _ends(word: str, suffixes: str) -> str:
    return "(" + " OR ".join(f"endswith({word}, '{suffix}')" for suffix in suffixes.split("|")) + ")"


def porter_stem(column: str) -> Column:
    """Stem of a column of lower-cased words; words of one or two characters stay as they are. For distinct words."""
    stem = column
    for suffixes, step in _STEPS:
        changed = _bound(shape("word"), "shape", step("word", "shape"))
        stem = _bound(stem, "word", f"if({_ends('word', suffixes)}, {changed}, word)")
    return F.expr(f"if(length({column}) < 3, {column}, {stem})")
