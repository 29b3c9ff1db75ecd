"""Secret scans: assignments, access keys and hex runs by pattern, random strings by token efficiency.

A language text takes few tokens a character under a byte-pair vocabulary; a random string takes many. A run of key
characters with letters whose characters per token lie under a ratio (a stricter one without digits) is reported as
`random`, unless it is a digest of a usual length, a UUID, a number or another known identifier. Of a run that touches
spans that patterns have found, what they leave is measured. A run that is not random as a whole is measured by its pieces between separators as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import as_struct, hold_alone, slices, text_or_empty

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A candidate has so many characters at least, and so many a token at most.
RANDOM_LENGTH = 20
RANDOM_RATIO = 2.2
#: The same for runs without a digit, as long compounds take more tokens than other words.
LETTERS_RATIO = 2.0

KINDS = ("assign", "access", "hex", "random")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # greedy: the runs that [0-9a-f]+ finds, less those that are too short
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RANDOM_LENGTH)
#: What a run has between separators; a digest and its name are one piece.
_PIECE = re.compile(r"(?:sha(?:1|224|256|384|512)|md5)-[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9+]+", re.IGNORECASE | re.ASCII)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|(?:sha(?:1|224|256|384|512)|md5)-[A-Za-z0-9+/]+={0,2})", re.IGNORECASE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _is_known(run: str) -> bool:
    return bool(_UUID.fullmatch(run) or _DIGEST.fullmatch(run))


def pattern_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the pattern matches, in code points; unordered."""
    found = []
    lower = text.lower()
    if any(x in lower for x in _NAMES):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def _is_random(run: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    if len(run) < RANDOM_LENGTH or not re.search("[A-Za-z]", run) or _is_known(run):
        return False
    return len(run) <= (ratio if re.search("[0-9]", run) else min(ratio, LETTERS_RATIO)) * len(encoding.encode_ordinary(run))


def _outside(a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches of a to b that spans, which are in order and do not meet, leave."""
    left = []
    for k in range(bisect_right(spans, a, key=lambda s: s[1]), len(spans)):
        x, y = spans[k]
        if x >= b:
            break
        if x > a:
            left.append((a, x))
        a = y
    return [*left, (a, b)] if a < b else left


def _united(taken: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(taken):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def random_spans(text: str, encoding: tiktoken.Encoding, taken: list[tuple[int, str, int]], ratio: float = RANDOM_RATIO) -> list[tuple[int, str, int]]:
    """Spans outside those taken by patterns. What the hex pattern leaves of a random piece goes too, however short it is."""
    found: set[tuple[int, int]] = set()
    every, hexes = _united(taken), {(a, b) for a, kind, b in taken if kind == "hex"}
    for m in _RUN.finditer(text):
        if _is_known(m[0]):
            continue
        left = _outside(*m.span(), every)
        mine: list[tuple[int, int]] = []  # in order
        for a, b in left:
            if _is_random(text[a:b], encoding, ratio):
                mine.append((a, b))
            else:
                mine += [p.span() for p in _PIECE.finditer(text, a, b) if _is_random(p[0], encoding, ratio)]
        found.update(mine)
        if left and left != [m.span()] and hexes:
            for p in _PIECE.finditer(text, *m.span()):
                rest = _outside(*p.span(), every)
                inner = _outside(*p.span(), rest)
                if rest and inner and all(x in hexes for x in inner) and _is_random(p[0], encoding, ratio):
                    found.update(x for x in rest if _outside(*x, mine) == [x])
    return [(a, "random", b) for a, b in sorted(found)]


def _ordered(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def scan(text: str, encoding: tiktoken.Encoding) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The pattern spans, and all spans, each in order."""
    base = _ordered(pattern_spans(text))
    return base, _ordered(base + random_spans(text, encoding, base))


def _said(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def redacted(text: str, spans: list[tuple[int, str, int]], by: str = "[secret]") -> str:
    """text with each stretch that spans cover, overlapping ones as one, replaced."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


SCHEMA = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string,redacted:string>"


def scan_column(name: str = "text", path: str | None = None, with_text: bool = False) -> Column:
    """A struct of the scan's results; redacted is null unless with_text is set."""
    path = path or default_path()

    @F.arrow_udf(SCHEMA)
    def scanned(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hold_alone("secrets", vocabulary.cache_clear)
        encoding = vocabulary(path)
        for part in slices(parts):
            rows = []
            for text in part.to_pylist():
                base, spans = scan(text or "", encoding)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), redacted(text or "", spans) if with_text else None))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 3
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]
            yield pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names)

    return scanned(text_or_empty(name))


def secret_scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs.

    A null text counts as empty, and like an empty one has no spans; repeated rows and ids are scanned each; a text may be
    of any length, as the work grows with it and no faster; an empty table gives an empty one. Other columns are ignored.
    """
    return docs.select("doc_id", scan_column("text", path).alias("s")).select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans")


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with every secret in text replaced, n_chars (if there is one) set anew, and null texts left null; all rows and columns stay."""
    scanned = docs.select(as_struct(docs).alias("doc"), scan_column("text", path, with_text=True).alias("scan"))
    new = {"text": F.when(F.col("doc.text").isNotNull(), F.col("scan.redacted"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("scan.spans") != "", F.length("scan.redacted").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("doc.n_chars"))
    return scanned.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
