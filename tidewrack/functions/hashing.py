"""Murmur3 and XXH3 hashes of texts and word shingles, over whole batches in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shingles that are hashed at once.
CHUNK = 100_000

# The constants of the public-domain MurmurHash3 (x64, 128 bits).
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_ADD1, _ADD2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def murmur3_128(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash (seed 0) of each stretch of data (uint8), given by its start and length."""
    n = len(starts)
    h1, h2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    blocks = lengths // 16
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    every = np.lib.stride_tricks.as_strided(padded, shape=(len(padded) - 7, 8), strides=(1, 1))

    def word(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The eight bytes from `at` on, as a little-endian number."""
        return every[at].copy().view("<u8").reshape(len(rows))

    for k in range(int(blocks.max()) if n else 0):
        rows = np.flatnonzero(blocks > k)
        at = starts[rows] + 16 * k
        a, b = h1[rows], h2[rows]
        a ^= _rotated(word(rows, at) * _C1, 31) * _C2
        a = (_rotated(a, 27) + b) * np.uint64(5) + _ADD1
        b ^= _rotated(word(rows, at + 8) * _C2, 33) * _C1
        b = (_rotated(b, 31) + a) * np.uint64(5) + _ADD2
        h1[rows], h2[rows] = a, b
    tail = lengths % 16
    rows = np.flatnonzero(tail > 0)
    if len(rows):
        at = starts[rows] + 16 * blocks[rows]
        low = np.minimum(tail[rows], 8).astype(np.uint64)
        high = np.maximum(tail[rows] - 8, 0).astype(np.uint64)

        def first(x: np.ndarray, count: np.ndarray) -> np.ndarray:
            """Only the first `count` bytes of each number."""
            mask = np.where(count >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(count, np.uint64(7)) * np.uint64(8))) - np.uint64(1))
            return x & mask

        behind = np.minimum(at + 8, len(padded) - 8)  # not used where nothing is left there
        h2[rows] ^= np.where(high > 0, _rotated(first(word(rows, behind), high) * _C2, 33) * _C1, np.uint64(0))
        h1[rows] ^= _rotated(first(word(rows, at), low) * _C1, 31) * _C2
    size = lengths.astype(np.uint64)
    h1, h2 = h1 ^ size, h2 ^ size
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _finished(h1), _finished(h2)
    h1 = h1 + h2
    return h1, h2 + h1


def shingles(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and the starts and lengths of the shingles of a text whose words are parted by single blanks."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return data, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    blanks = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(data)]])
    many = max(1, len(starts) - width + 1)
    last = ends[width - 1 :] if len(starts) >= width else ends[-1:]
    return data, starts[:many], last - starts[:many]


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums >= 0, bitorder="little").view("<i8")


def weighted_signature(h1: np.ndarray, h2: np.ndarray, rarity: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[int, int]:
    """(hi, lo), signed: bits whose sum is not negative, each distinct shingle for or against a bit with the weight 1 + ln(1 + its number), times its rarity, if that is given."""
    _, first, counts = np.unique(h1, return_index=True, return_counts=True)  # equal shingles; others share 64 bits by chance only
    pairs = np.stack([h1[first], h2[first]], axis=1)
    weights = 1 + np.log1p(counts)
    if rarity is not None:
        weights = weights * rarity(h1[first], h2[first])
    bits = np.unpackbits(pairs.view(np.uint8).reshape(len(pairs), 16), axis=1, bitorder="little")
    lo, hi = _packed(2 * (weights @ bits.astype(np.float64)) - weights.sum()).tolist()
    return hi, lo


def simhash64(h1: np.ndarray) -> int:
    """Signed: bits that half of the shingles or more have, each time they occur."""
    ones = np.unpackbits(np.ascontiguousarray(h1).view(np.uint8).reshape(len(h1), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_packed(2 * ones - len(h1))[0])


def hashedshingles(texts: list[str | None], width: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both hash halves of each text's shingles, in order; texts are normalized. Many short texts are hashed together."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begins = np.cumsum([0] + [len(d) for d, _, _ in held])
        h1, h2 = murmur3_128(np.concatenate([d for d, _, _ in held]), np.concatenate([s + b for (_, s, _), b in zip(held, begins)]), np.concatenate([n for _, _, n in held]))
        cuts = np.cumsum([len(s) for _, s, _ in held])[:-1]
        yield from zip(np.split(h1, cuts), np.split(h2, cuts))

    for text in texts:
        held.append(shingles((text or "").encode("utf-8", "replace"), width))
        size += len(held[-1][1])
        if size > CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


@F.arrow_udf(T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("simhash64", T.LongType())]))
def signatures_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The weighted 128-bit signature and the plain 64-bit one of normalized texts; null and 0 for texts without words."""
    for part in texts:
        found = [(*weighted_signature(a, b), simhash64(a)) if len(a) else (None, None, 0) for a, b in hashedshingles(part.to_pylist())]
        yield pa.StructArray.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["hi", "lo", "simhash64"])


def _hexed(name: str):
    @F.arrow_udf(T.StringType())
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        digest = getattr(xxhash, name)
        for part in texts:
            yield pa.array([None if x is None else digest(x.encode("utf-8", "replace")) for x in part.to_pylist()], pa.string())

    return run


#: XXH3 in hexadecimal digits, of 64 and 128 bits.
xxh3_64_hex, xxh3_128_hex = _hexed("xxh3_64_hexdigest"), _hexed("xxh3_128_hexdigest")
