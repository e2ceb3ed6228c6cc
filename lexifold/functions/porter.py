"""Porter's suffix stripping, as published in 1980 with its author's two later rules.

A stem is tested with four patterns over runs of consonants (C) and vowels (V), as
the published algorithm writes words: [C](VC){m}[V].
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
ONE_OR_MORE = rf"^(?:{_C})?{_V}{_C}"
EXACTLY_ONE = rf"^(?:{_C})?{_V}{_C}(?:{_V})?$"
TWO_OR_MORE = rf"^(?:{_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = rf"^(?:{_C})?[aeiouy]"
SHORT_END = rf"^{_C}[aeiouy][^aeiouwxy]$"
#: Porter's suffix tables, each with what replaces it.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_ONE, _SINGLE, _TWO, _VOWEL, _SHORT = map(re.compile, (ONE_OR_MORE, EXACTLY_ONE, TWO_OR_MORE, HAS_VOWEL, SHORT_END))


def _tabled(word: str, table, test) -> str:
    for suffix, instead in table:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + instead if test.search(base) else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a folded word; any that isn't ASCII letters, or has at most two, is left as it is."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _ONE.search(word[:-3]) else word
    elif m := re.search(r"(?:ed|ing)$", word):
        base = word[: m.start()]
        if _VOWEL.search(base):
            if base.endswith(("at", "bl", "iz")):
                base += "e"
            elif re.search(r"([^aeiouylsz])\1$", base):
                base = base[:-1]
            elif _SINGLE.search(base) and _SHORT.search(base):
                base += "e"
            word = base
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _tabled(_tabled(word, STEP_2, _ONE), STEP_3, _ONE)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _TWO.search(base) and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _TWO.search(base) or _SINGLE.search(base) and not _SHORT.search(base):
            word = base
    return word[:-1] if word.endswith("ll") and _TWO.search(word) else word


@F.pandas_udf(T.StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    """Stem of each folded word; null stays null."""
    return words.map(stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_arrays(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda words: [stem(w) for w in words], na_action="ignore")


def stems(words: Column) -> Column:
    """The stems of an array of folded words, in order."""
    return _stem_arrays(words)


@F.pandas_udf(T.MapType(T.StringType(), T.LongType()))
def occurrences(arrays: pd.Series) -> pd.Series:
    """How often each word of an array occurs.

    All words of a document lie in one row, so they are counted there and only
    distinct ones go on; exploding first would send every word through a shuffle.
    """
    return arrays.map(lambda words: dict(Counter(words)), na_action="ignore")


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.LongType())))
def occurrences_by_part(first: pd.Series, second: pd.Series) -> pd.Series:
    """How often each word occurs in the first and in the second of two arrays."""

    def counted(a, b) -> dict[str, list[int]]:
        left, right = Counter(a), Counter(b)
        return {w: [left[w], right[w]] for w in {**left, **right}}

    return pd.Series([counted(a, b) for a, b in zip(first, second)])
