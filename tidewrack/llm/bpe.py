"""BPE encoding and decoding by a prefix-sharing trie.

A text is cut into space-free chunks, chunks into pre-tokens, and what a chunk encodes to is kept, so a text is two
table look-ups a chunk. Chunks that are not yet known are gathered over a whole Arrow batch; their distinct pre-tokens
go into one trie of byte symbols, kept as a sorted list. A depth-first walk carries, for the prefixes that are asked for, the last token
of that prefix's encoding: the one vocabulary entry ending there that may follow the last token of what precedes it. A prefix that many
words share is thus encoded once at most, and a word's encoding is read back by following last tokens from its end.

What is kept has two generations. A full one becomes the old one; what is found there moves to the new one, so words in use stay.

Two tokens may stand side by side if merging their symbols from scratch keeps them apart: no symbol that ends the left
one during its merges and no symbol that begins the right one at the same time form a pair that merges earlier.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import hold_alone, slices, text_or_empty

VOCABULARY = "word_bpe_49k.json"
#: A generation of known chunks (with pre-tokens of ASCII), or of other pre-tokens, is full at so many; pairs of tokens are forgotten beyond so many.
KEPT_CHUNKS = 250_000
KEPT_WORDS = 50_000
KEPT_PAIRS = 300_000
#: A chunk or pre-token of more characters is encoded but not kept.
KEPT_LENGTH = 64
#: In a pre-token of more symbols the last tokens of all prefixes are worked out in order, as asking for them from the end would nest too deep.
NESTED_LENGTH = 200

_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACES = re.compile("[\x1c-\x1f]")
_PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ASCII_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_NOT_LETTERS = regex.compile(r"[^\p{L}]")
_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class TrieEncoder:
    """Encodes pre-tokens of one vocabulary (a JSON file of the tokenizers library with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = n
            self.parts[whole] = (left, right)
            self.born[whole] = n
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for s, i in self.ids.items():
            if s.endswith(_END) and len(s) > len(_END):
                self.final[s[: -len(_END)]] = i
            else:
                self.inner[s] = i
        self.inner_reach, self.final_reach = self._reach(self.inner), self._reach(self.final)
        self.length = {i: len(s) for s, i in self.inner.items()} | {i: len(s) for s, i in self.final.items()}
        self.bytes = {i: i.to_bytes(4, "little") for i in self.names}
        self.symbols = byte_symbols()
        self._edges: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
        self._fits: dict[int, bool] = {}
        self.width = max(self.names) + 1
        self.split_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def _edge(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """The symbols that stand at an end of token while it is merged (side 1: its right end, 0: its left), with the merges that make and use up each."""
        key = (token, side)
        if key not in self._edges:
            found, used, symbol = [], float("inf"), token
            while True:
                made = self.born.get(symbol, -1)
                found.append((symbol, made, used))
                if symbol not in self.parts:
                    break
                symbol, used = self.parts[symbol][side], made
            self._edges[key] = found
        return self._edges[key]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their symbols are merged together."""
        key = left * self.width + right
        known = self._fits.get(key)
        if known is None:
            known = True
            for a, made_a, used_a in self._edge(left, 1):
                for b, made_b, used_b in self._edge(right, 0):
                    n = self.rank.get((a, b))
                    if n is not None and n < used_a and n <= used_b and made_a < used_b and made_b < used_a:
                        known = False
            if len(self._fits) > KEPT_PAIRS:
                self._fits.clear()
            self._fits[key] = known
        return known

    def _reach(self, table: dict[str, int]) -> dict[str, int]:
        """The length of the longest entry that ends in each three symbols."""
        out: dict[str, int] = {}
        for s in table:
            if len(s) >= 3:
                out[s[-3:]] = max(out.get(s[-3:], 0), len(s))
        return out

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of each distinct pre-token, given as byte symbols.

        The sorted words are the trie, in the order of a depth-first walk: from one word to the next, the walk goes up
        to the end of their common prefix and down the rest. `lasts` is the path's state, None where nothing has asked for it yet.
        """
        out: dict[str, list[int]] = {}
        inner, final, length, width = self.inner.get, self.final.get, self.length, self.width
        inner_reach, final_reach = self.inner_reach.get, self.final_reach.get
        known, fits = self._fits.get, self.fits
        lasts: list[int | None] = [-1]  # lasts[k]: the last token of the first k symbols
        before = word = ""

        def last(d: int) -> int:
            for j in range(max(0, d - inner_reach(word[d - 3 : d], 2)) if d > 2 else 0, d):
                token = inner(word[j:d])
                if token is not None:
                    if not j:
                        break
                    left = lasts[j]
                    if left is None:
                        left = last(j)
                    fit = known(left * width + token)
                    if fit or (fit is None and fits(left, token)):
                        break
            else:
                token = -1
            lasts[d] = token
            return token

        for word in sorted(words):
            n = len(word)
            k, most = 0, min(len(before), n) - 1
            while k < most and before[k] == word[k]:
                k += 1
            before = word
            del lasts[k + 1 :]
            lasts += [None] * (n - 1 - k)
            if n > NESTED_LENGTH:
                for d in range(k + 1, n):
                    last(d)
            for j in range(max(0, n - final_reach(word[n - 3 : n], 2)) if n > 2 else 0, n):
                token = final(word[j:n])
                if token is not None:
                    if not j:
                        break
                    left = lasts[j]
                    if left is None:
                        left = last(j)
                    fit = known(left * width + token)
                    if fit or (fit is None and fits(left, token)):
                        break
            ids, at = [token], n - length[token]
            while at > 0:
                token = lasts[at]
                ids.append(token)
                at -= length[token]
            ids.reverse()
            out[word] = ids
        return out


class TextEncoder:
    """Whole texts to ids and back, keeping what chunks and pre-tokens give."""

    def __init__(self, path: str):
        self.trie = TrieEncoder(path)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.names = np.array([self.trie.names.get(i, "") for i in range(max(self.trie.names) + 1)], dtype=object)
        self.table = {b: c for b, c in enumerate(self.trie.symbols) if chr(b) != c}

    def pieces(self, text: str) -> list[str]:
        """Space-free chunks and special tokens, in order. Those of Latin-1 texts are in lower case, so fewer are to be known: there it is told letter by letter, and NFC changes nothing."""
        if "<|" in text:
            out = []
            for k, part in enumerate(self.trie.split_pattern.split(text)):
                out += [part] if k % 2 else self._chunks(part)
            return out
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._chunks(text)
        return self._chunks(text.lower())

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return [x for x in _SPACES.split(text) if x] if _ODD_SPACES.search(text) else text.split()

    def _pretokens(self, chunk: str) -> list[str]:
        if chunk.isascii():  # printable ASCII characters are their own byte symbols
            lower = chunk if chunk.islower() else chunk.lower()
            if lower[:-1].isalpha() and lower[-1] in ".,;:!?":
                return [lower[:-1], lower[-1]]
            return [lower] if lower.isalpha() else [w if w.isprintable() else self._symbols(w) for w in _ASCII_PRETOKENS.findall(lower)]
        text = unicodedata.normalize("NFC", chunk)
        lower = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # by characters: no final sigma
        return [self._symbols(w) for w in ([lower] if lower.isalpha() and not _NOT_LETTERS.search(lower) else _PRETOKENS.findall(lower))]

    def _symbols(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.table)

    def decode(self, raw: bytes) -> str:
        """The text of ids (little-endian, 32 bits each): their tokens with blanks between, special ones too, as this vocabulary has no decoder of its own."""
        return " ".join(self.names[np.frombuffer(raw, "<u4")].tolist())

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Encodes chunks that are not known; returns what they give. Those too long are not kept."""
        if len(self.words) > KEPT_WORDS:
            self.words, self.old_words = {}, self.words
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks, self.old_chunks = {}, self.chunks
        raw, special = self.trie.bytes, self.trie.special
        cut = {c: self._pretokens(c) for c in chunks if c not in special}
        found: dict[str, bytes | None] = {}
        for ws in cut.values():
            for w in ws:
                if w not in found:
                    found[w] = self._known(w)
        for w, ids in self.trie.encode_words([w for w, x in found.items() if x is None]).items():
            found[w] = x = b"".join([raw[i] for i in ids])
            if len(w) <= KEPT_LENGTH:
                (self.chunks if w.isascii() else self.words)[w] = x
        fresh = {}
        for c, ws in cut.items():
            fresh[c] = x = found[ws[0]] if len(ws) == 1 else b"".join([found[w] for w in ws])
            if len(c) <= KEPT_LENGTH:
                self.chunks[c] = x
        for c in chunks:
            if c in special:
                fresh[c] = self.chunks[c] = raw[special[c]]
        return fresh

    def _known(self, word: str) -> bytes | None:
        """What a pre-token gives, if kept. One of ASCII is a chunk too, as it is its own byte symbols and its only pre-token."""
        kept, old = (self.chunks, self.old_chunks) if word.isascii() else (self.words, self.old_words)
        known = kept.get(word)
        if known is None:
            known = old.get(word)
            if known is not None:
                kept[word] = known
        return known

    def encode(self, texts: list[str], block: int = 1_000_000) -> Iterator[tuple[bytes, str]]:
        """For each text the ids as little-endian unsigned 32-bit integers, and the text that they decode to. Blocks bound what is held at once."""
        k = 0
        while k < len(texts):
            some, unknown, size = [], set(), 0
            while k < len(texts) and (not some or size < block):
                pieces = self.pieces(texts[k])
                got = list(map(self.chunks.get, pieces))
                missing = []
                for n in [n for n, g in enumerate(got) if g is None] if None in got else ():
                    piece = pieces[n]
                    known = self.old_chunks.get(piece)
                    if known is None:
                        missing.append((n, piece))
                    else:
                        got[n] = self.chunks[piece] = known
                unknown.update([piece for _, piece in missing])
                some.append((got, missing))
                size += len(texts[k])
                k += 1
            fresh = self.learn(unknown) if unknown else {}
            for got, missing in some:
                for n, piece in missing:
                    got[n] = fresh[piece]
                ids = b"".join(got)
                yield ids, self.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


SCHEMA = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,ids:binary,decoded:string>"


def encoded_column(name: str = "text", path: str | None = None, with_ids: bool = False, with_decoded: bool = False) -> Column:
    """A struct of n_tokens, ids_sha256, decoded_sha256, ids and decoded; the last two are null unless asked for."""
    path = path or default_path()

    @F.arrow_udf(SCHEMA)
    def encoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hold_alone("bpe", encoder.cache_clear)
        made = encoder(path)
        for part in slices(parts):
            n, shas, decoded_shas, ids, decoded = [], [], [], [], []
            for raw, said in made.encode([x or "" for x in part.to_pylist()]):
                n.append(len(raw) // 4)
                shas.append(hashlib.sha256(raw).hexdigest())
                decoded_shas.append(hashlib.sha256(said.encode()).hexdigest())
                ids.append(raw if with_ids else None)
                decoded.append(said if with_decoded else None)
            arrays = [pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.StructArray.from_arrays(arrays, ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return encoded(text_or_empty(name))


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, as binary, if asked for) for each row of docs. A null text counts as empty and has no tokens; other columns are ignored."""
    out = docs.select("doc_id", encoded_column("text", path, with_ids).alias("e"))
    return out.select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256", *(["e.ids"] if with_ids else []))
