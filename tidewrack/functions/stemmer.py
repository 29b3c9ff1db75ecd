"""The English Snowball stemmer (Porter2), for the distinct words of an index or a query."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The algorithm's endings and exceptions, as published.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_PLURALS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_V = "[aeiouy]"
_REGION = re.compile(rf"{_V}[^aeiouy]")
_SHORT_END = re.compile(rf"(?:^{_V}[^aeiouy]|[^aeiouy]{_V}[^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        m = _REGION.search(word)
        first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plurals(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        return w[:-1]
    return w


def _participles(w: str, r1: int) -> str:
    end = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if not end or not re.search(_V, w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if len(w) <= r1 and _SHORT_END.search(w) else w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters and words with letters beyond a-z stay."""
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    w = word.removeprefix("'")
    w = re.sub(rf"(^|{_V})y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    w = _plurals(w)
    if w in AFTER_PLURALS:
        return w
    w = _participles(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _longest(w, [*STEP_2, "ogi", "li"])
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif end == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(end)] + STEP_2[end]
    end = _longest(w, [*STEP_3, "ative"])
    if end and len(w) - len(end) >= r1:
        if end == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, [*STEP_4, "ion"])
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.arrow_udf(StringType())
def _stems(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        yield pa.array([None if x is None else stem(x) for x in part.to_pylist()], pa.string())


def stems(terms: DataFrame) -> DataFrame:
    """terms: distinct terms in column term. (term, stem); what search.postings takes as its stem."""
    return terms.select("term", _stems("term").alias("stem"))
