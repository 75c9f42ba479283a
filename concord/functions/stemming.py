"""English stems of words by suffix rules (the public Porter2 algorithm), for text chains.

The rules are plain Python over one word. As a chain step they run over whole arrays of terms in Arrow batches, once per different
word of a batch, and a worker remembers the words it had.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

# fixed values of the algorithm
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
WHOLE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
_REGION = re.compile("[aeiouy][^aeiouy]")
_PREFIX = re.compile("gener|commun|arsen")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_VOWEL = re.compile("[aeiouy]")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _after(word: str, start: int) -> int:
    """Where the region behind the first non-vowel that follows a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    prefix = _PREFIX.match(word)
    r1 = prefix.end() if prefix else _after(word, 0)
    r2 = _after(word, r1)
    in_r1 = lambda suffix: len(word) - len(suffix) >= r1
    in_r2 = lambda suffix: len(word) - len(suffix) >= r2

    # plurals and possessives
    if suffix := _longest(word, ("'", "'s", "'s'")):
        word = word[: -len(suffix)]
    suffix = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        word = word[:-2]
    elif suffix in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif suffix == "s" and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in WHOLE:
        return word

    # past and present participles
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if in_r1(suffix):
            word = word[: -len(suffix)] + "ee"
    elif suffix and _VOWEL.search(word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and not _VOWEL.match(word[-2]):
        word = word[:-1] + "i"

    # derivational endings
    suffix = _longest(word, STEP_2)
    if suffix and in_r1(suffix):
        before = word[: -len(suffix)]
        if suffix not in ("ogi", "li") or suffix == "ogi" and before.endswith("l") or suffix == "li" and before[-1:] in tuple("cdeghkmnrt"):
            word = before + STEP_2[suffix]
    suffix = _longest(word, STEP_3)
    if suffix and in_r1(suffix) and (suffix != "ative" or in_r2(suffix)):
        word = word[: -len(suffix)] + STEP_3[suffix]
    suffix = _longest(word, STEP_4)
    if suffix and in_r2(suffix) and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(suffix)]
    if word.endswith("e") and (in_r2("e") or in_r1("e") and not _SHORT.search(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and in_r2("l"):
        word = word[:-1]
    return word.replace("Y", "y")


#: Words that a worker remembers, after which it starts anew.
MEMO = 500_000
_known: dict[str, str] = {}


def _stems(words: list[str]) -> list[str]:
    if len(_known) > MEMO:
        _known.clear()
    for word in set(words).difference(_known):
        _known[word] = stem(word)
    return [_known[w] for w in words]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def stem_all(texts: pd.Series) -> pd.Series:
    """Stems of the terms of every text: an array of texts, each an array of terms."""
    rows = [None if row is None else [None if terms is None else list(terms) for terms in row] for row in texts]
    stems = iter(_stems([w for row in rows if row is not None for terms in row if terms is not None for w in terms]))
    return pd.Series([None if row is None else [None if terms is None else [next(stems) for _ in terms] for terms in row] for row in rows])
