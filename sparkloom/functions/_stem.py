"""The Porter stemmer, from its published description (M. F. Porter, 1980)."""

from __future__ import annotations

import re

_V = "(?:[aeiou]|(?<=[^aeiou])y)"
_MEASURE = re.compile(f"{_V}+(?:(?!{_V})[a-z])+")
_VOWEL = re.compile(_V)
_DOUBLE = re.compile(r"([^aeiouy])\1$")
_SHORT_END = re.compile(r"(?:^|[^a-z]|.)[^aeiou][aeiouy][^aeiouwxy]$")

# Fixed values of the published steps: suffix and what takes its place.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def measure(stem: str) -> int:
    """How many vowel runs followed by consonants a stem has."""
    return len(_MEASURE.findall(stem))


def _ends_short(word: str) -> bool:
    if len(word) < 3:
        return False
    kinds = ["v" if _VOWEL.match(word, i) else "c" for i in range(len(word) - 3, len(word))]
    return kinds == ["c", "v", "c"] and word[-1] not in "wxy"


def _replace(word: str, rules, least: int) -> str:
    for suffix, other in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + other if measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-cased English word; words of one or two letters stay."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _VOWEL.search(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _DOUBLE.search(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and _ends_short(word):
                    word += "e"
                break
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _STEP2, 0)
    word = _replace(word, _STEP3, 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _ends_short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word
