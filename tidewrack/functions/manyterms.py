"""Many terms in one pass over each text, by an automaton of all of them (Aho-Corasick).

The rules are those of tokens.matches: whatever the case, with ASCII word edges on both sides of a term.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidewrack.functions.tokens import checked_term

#: What lower case leaves or lengthens, but a pattern without case takes for an ASCII letter.
_FOLDED = {0x17F: "s", 0x130: "i"}
_WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]):
    import ahocorasick

    found: dict[str, list[int]] = {}
    for k, term in enumerate(terms):
        found.setdefault(term.lower(), []).append(k)
    built = ahocorasick.Automaton()
    for term, numbers in found.items():
        built.add_word(term, (len(term), numbers))
    built.make_automaton()
    return built


def found_terms(text: str, built) -> set[int]:
    """Numbers of the terms that a text has as words."""
    plain = text.translate(_FOLDED).lower()  # as long as text: every code point gives one
    out: set[int] = set()
    for end, (size, numbers) in built.iter(plain):
        if numbers[0] in out:
            continue
        first = end - size + 1
        before, after = text[first - 1] if first else "", text[end + 1 : end + 2]
        # an edge lies where just one side is a word character
        if ((before in _WORD and before != "") != (plain[first] in _WORD)) and ((after in _WORD and after != "") != (plain[end] in _WORD)):
            out.update(numbers)
    return out


def terms_found(terms: list[str], *columns: str) -> Column:
    """An array of the numbers (from 0) of the terms that any of the columns has. Terms are ASCII."""
    wanted = tuple(checked_term(t) for t in terms)
    if not all(t.isascii() for t in wanted):
        raise ValueError("terms of the automaton are ASCII; use tokens.matches for others")

    @F.arrow_udf(ArrayType(IntegerType()))
    def found(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        built = automaton(wanted)
        for part in parts:
            rows = zip(*[c.to_pylist() for c in part])
            yield pa.array([sorted(set().union(*[found_terms(x, built) for x in row if x])) for row in rows], pa.list_(pa.int32()))

    return found(*columns, F.lit(""))  # two columns at least, so that rows come as tuples
