"""Text cleaning, quality gates, language tags and topic filters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.tokens import topic_pattern

# The gates of the quality check.
GATE_STOPWORDS = frozenset("the be to of and that have with".split())
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN_LENGTH, MAX_MEAN_LENGTH = 3.0, 10.0
MAX_SYMBOL_RATIO, MAX_BULLET_LINES, MAX_ELLIPSIS_LINES, MIN_ALPHA_WORDS, MIN_STOPWORDS = 0.10, 0.90, 0.30, 0.80, 2
BULLETS = "•-*·‣◦"


@F.arrow_udf(T.StringType())
def nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode NFKC, which Spark has no function for; ASCII texts go through untouched."""
    for part in texts:
        yield pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in part.to_pylist()], type=pa.string())


def basic_clean(text: Column, normalize: bool = True) -> Column:
    """NFKC, no control characters, \\n line ends, no blanks at line ends, runs of blanks as one, at most one empty line, trimmed."""
    out = nfkc(text) if normalize else text
    for pattern, by in ((r"\r\n?", "\n"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), (r"[ \t]+\n", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def normalized(df: DataFrame, min_chars: int = 200, max_chars: int = 1_500_000) -> DataFrame:
    """Adds clean, n_chars, n_words, n_lines and discard (too_short, too_long or null)."""
    df = df.withColumn("clean", basic_clean(F.coalesce("text", F.lit(""))))
    n = F.length("clean")
    words = F.size(F.filter(F.split("clean", r"\s+"), lambda w: w != ""))
    return df.withColumns({"n_chars": n, "n_words": words, "n_lines": F.when(n > 0, F.size(F.split("clean", "\n"))).otherwise(0), "discard": F.when(n < min_chars, "too_short").when(n > max_chars, "too_long")})


def safe_title(title: Column, text: Column) -> Column:
    """The title, or else the first line with text, at most 512 characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.trim(F.get(lines, F.lit(0)))), 1, 512)


def gate_reason(text: Column) -> Column:
    """The first gate that a text fails, or null: word number, word length, symbols, bullets, ellipses, alphabetic words, stopwords."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    mean = F.length(F.regexp_replace(text, r"\s+", "")) / n
    symbols = F.regexp_count(text, F.lit(r"#|\.\.\.|…"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    n_lines = F.size(lines)
    bullets = F.size(F.filter(lines, lambda x: x.rlike(rf"^\s*[{BULLETS[0]}{BULLETS[2:]}\-]")))
    ellipses = F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$")))
    alpha = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    stops = F.size(F.array_intersect(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,!?;:\"'()\[\]]+|[.,!?;:\"'()\[\]]+$", ""))), F.array(*[F.lit(s) for s in sorted(GATE_STOPWORDS)])))
    return (
        F.when(n < MIN_WORDS, "too_few_words")
        .when(n > MAX_WORDS, "too_many_words")
        .when((mean < MIN_MEAN_LENGTH) | (mean > MAX_MEAN_LENGTH), "mean_word_length")
        .when(symbols / n > MAX_SYMBOL_RATIO, "symbol_to_word_ratio")
        .when((n_lines > 0) & (bullets / n_lines > MAX_BULLET_LINES), "bullet_lines")
        .when((n_lines > 0) & (ellipses / n_lines > MAX_ELLIPSIS_LINES), "ellipsis_lines")
        .when(alpha / n < MIN_ALPHA_WORDS, "low_alpha_fraction")
        .when(stops < MIN_STOPWORDS, "no_stopwords")
    )


def gate_for_language(text: Column, language: Column) -> Column:
    """The gate holds for English and unknown languages only."""
    return F.when(language.isNull() | F.lower(language).startswith("en"), gate_reason(text))


def language_tag(language: Column) -> Column:
    """Lower case, hyphens for underscores, no empty parts; null for nothing."""
    parts = F.filter(F.split(F.lower(F.replace(language, F.lit("_"), F.lit("-"))), "-"), lambda p: p != "")
    return F.nullif(F.array_join(parts, "-"), F.lit(""))


def language_filter(wanted: str, column: str = "language") -> Column:
    """A primary tag takes its subtags too; a full tag only itself."""
    tag = "-".join(p for p in wanted.lower().replace("_", "-").split("-") if p)
    value = language_tag(F.col(column))
    return value == tag if "-" in tag else (value == tag) | value.startswith(tag + "-")


@dataclass(frozen=True)
class TopicFilter:
    """Terms in title, text or both, any or all of them; terms are words, or patterns if regex is set."""

    terms: tuple[str, ...]
    match_all: bool = False
    fields: str = "both"
    regex: bool = False

    @classmethod
    def from_config(cls, cfg: dict | None) -> TopicFilter | None:
        terms = tuple(t.strip() for t in (cfg or {}).get("terms") or () if t and t.strip())
        return cls(terms, (cfg.get("mode") or "any").lower() in ("all", "and"), cfg.get("fields") or "both", bool(cfg.get("regex"))) if terms else None

    def column(self, title: str = "title", text: str = "text") -> Column:
        where = {"title": [title], "text": [text]}.get(self.fields, [title, text])
        hay = F.concat_ws("\n", *where)
        found = [F.coalesce(hay.rlike("(?iuU)" + t if self.regex else topic_pattern(t)), F.lit(False)) for t in self.terms]
        return reduce(lambda a, b: a & b if self.match_all else a | b, found)


LANGUAGE_MARKS = {
    "en": "the and of to in that is was for with".split(),
    "fr": "le la les des et une dans est pour que".split(),
    "de": "der die und das ist nicht ein den mit auf".split(),
    "es": "el los las que una por con para del como".split(),
}


def detect_language(text: Column, min_chars: int = 80, min_confidence: float = 0.5, chars: int | None = None) -> Column:
    """An approximation by function words of the whole text (the first `chars` characters, if given): the language with most of them, if it has half of all. Null for short texts."""
    tokens = F.regexp_extract_all(F.lower(text if chars is None else F.substring(text, 1, chars)), F.lit(r"\p{L}+"), F.lit(0))

    def found(words: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*words)))

    counts = F.array(*[F.struct(found(words).alias("n"), F.lit(lang).alias("lang")) for lang, words in sorted(LANGUAGE_MARKS.items())])
    best = F.array_max(counts)
    total = F.aggregate(counts, F.lit(0), lambda a, c: a + c["n"])
    return F.when((F.length(text) >= min_chars) & (best["n"] > 0) & (best["n"] / total >= min_confidence), best["lang"])


def min_chars_for(channel: Column, base: int = 200) -> Column:
    """Length floor: news channels take shorter texts."""
    return F.when(channel.rlike("^(rss|atom|json_feed|gdelt|sitemap)"), max(40, min(base, 80))).otherwise(base)


_CHARSET = re.compile(rb"charset=[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)


def decode_http(body: bytes, content_type: str | None = None) -> tuple[str, str]:
    """Text and charset: by byte-order mark, header, HTML meta, UTF-8, then Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace"), name
    said = [m[1].decode() for m in (_CHARSET.search((content_type or "").encode()), _CHARSET.search(body[:4096])) if m]
    for name in [*said, "utf-8"]:
        try:
            return body.decode(name), name.lower()
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("cp1252", "replace"), "cp1252"
