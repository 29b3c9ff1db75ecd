"""The sentiment lexicon: word sets, and how far words before a sentiment word reach.

The words below are a short general list of our own. Lexicon.of(...) takes another one from a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

POSITIVE = frozenset(
    """admirable admire amazing beautiful beneficial benefit brilliant calm charming cheerful comfortable delight delighted
    delightful eager effective efficient elegant enjoy enjoyable enjoyed excellent fair fantastic friendly generous gentle glad
    good grateful great happy helpful honest hope hopeful improve improved inspiring joy kind love loved lovely lucky nice
    perfect pleasant pleased praise proud reliable safe satisfied smart smooth splendid strong succeed success successful superb
    support thankful thrilled trust useful valuable warm welcome wise wonderful worthy""".split()
)
NEGATIVE = frozenset(
    """abuse afraid anger angry annoyed annoying anxious ashamed awful bad bitter boring broken cheat complain complaint confused
    corrupt cruel damage damaged danger dangerous defect defective despair dirty disappointed disaster disgust dishonest dreadful
    error evil fail failed failure false fault fear filthy flawed fool guilty harm harmful hate hated horrible hostile hurt ill
    jealous lonely lost mad misery mistake nasty offensive pain painful poor rude sad scared severe sick sorry stupid terrible
    tragedy tragic ugly unfair unhappy unsafe useless vicious violent weak worried worry worse worst wrong""".split()
)
# Words that turn or strengthen a sentiment word within the three tokens before it.
NEGATIONS = frozenset("not no never without despite lacks".split())
INTENSIFIERS = frozenset("very extremely strongly sharply significantly".split())
#: Words that a lexicon may have; they are literals of the plan.
MOST_WORDS = 20_000


@dataclass(frozen=True)
class Lexicon:
    positive: frozenset[str] = field(default=POSITIVE)
    negative: frozenset[str] = field(default=NEGATIVE)
    negations: frozenset[str] = field(default=NEGATIONS)
    intensifiers: frozenset[str] = field(default=INTENSIFIERS)
    reach: int = 3
    intensity: float = 0.5

    @classmethod
    def of(cls, words: DataFrame) -> Lexicon:
        """From a table of word and polarity (above, below or at 0: positive, negative, no part of it); a larger one than MOST_WORDS is refused."""
        rows = words.select("word", "polarity").limit(MOST_WORDS + 1).collect()
        if len(rows) > MOST_WORDS:
            raise ValueError(f"a lexicon has up to {MOST_WORDS} words")
        return cls(*[frozenset(r.word.lower() for r in rows if r.word and sign * (r.polarity or 0) > 0) for sign in (1, -1)])


DEFAULT = Lexicon()
