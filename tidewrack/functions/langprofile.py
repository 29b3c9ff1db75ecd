"""Languages told by profiles of letters, learnt by Spark from labelled texts: hashed runs of one to three characters, naive Bayes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
MOST_LANGUAGES = 256
#: Fixed odd factors of the hash.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def bins_of(text: str | None, bits: int = BITS) -> np.ndarray:
    """Bins of all runs of one to three characters in the lower-case text, whose other characters than letters are single blanks around words."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    distinct, places = np.unique(codes, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in distinct.tolist()])[places]
    codes = np.where(letters, codes, np.uint32(32))
    codes = codes[letters | np.concatenate([[True], letters[:-1]])].astype(np.uint64)  # of blanks the first
    if len(codes) < 2:
        return np.empty(0, dtype=np.int64)
    found, mixed = [], np.zeros(len(codes), dtype=np.uint64)
    for n, factor in enumerate(FACTORS):
        mixed = (mixed[: len(codes) - n] ^ codes[n:]) * factor
        mixed ^= mixed >> np.uint64(29)
        found.append((mixed * FACTORS[0]) >> np.uint64(64 - bits))
    return np.concatenate([found[0][codes != 32], *found[1:]]).astype(np.int64)


@dataclass(frozen=True)
class Profiles:
    """Log probabilities of the bins for each language: languages x 2^bits floats, whatever the corpus."""

    languages: tuple[str, ...]
    logs: np.ndarray
    bits: int

    def posterior(self, text: str | None) -> np.ndarray | None:
        """Probabilities of the languages; None for a text without letters."""
        bins = bins_of(text, self.bits)
        if not len(bins) or not self.languages:
            return None
        used, times = np.unique(bins, return_counts=True)
        score = self.logs[:, used] @ times.astype(np.float64)
        share = np.exp(score - score.max())
        return share / share.sum()


def learn(df: DataFrame, text: str = "text", language: str = "language", bits: int = BITS, smoothing: float = 0.5) -> Profiles:
    """Profiles of all languages of the rows; null labels and texts are passed over, so are texts without letters.

    Tasks count by language and bin, and the counts are added up: at most languages x 2^bits rows reach the driver. More
    than 256 different labels are an error.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for body, label in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist()):
                if label not in sums:
                    if len(sums) >= MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} languages")
                    sums[label] = np.zeros(1 << bits, dtype=np.int64)
                bins = bins_of(body, bits)
                if len(bins) > 1 << (bits - 3):
                    sums[label] += np.bincount(bins, minlength=1 << bits)
                else:
                    np.add.at(sums[label], bins, 1)
        for label, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used])], names=["l", "bin", "n"])

    rows = df.select(F.col(text).cast("string").alias("t"), F.col(language).cast("string").alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    table = rows.mapInArrow(counted, "l string, bin int, n long").groupBy("l", "bin").agg(F.sum("n").alias("n")).limit((MOST_LANGUAGES << bits) + 1).toArrow()
    names = sorted(set(table.column("l").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.full((len(names), 1 << bits), smoothing)
    place = {name: k for k, name in enumerate(names)}
    counts[[place[x] for x in table.column("l").to_pylist()], table.column("bin").to_numpy()] += table.column("n").to_numpy()
    return Profiles(tuple(names), np.log(counts / counts.sum(axis=1, keepdims=True)), bits)


def detector(profiles: Profiles, min_chars: int = 80, min_confidence: float = 0.5) -> Callable[[Column], Column]:
    """text -> struct(language, confidence) of whole texts: the likeliest language (ties: the first by name), if it is likely enough. Null for short texts and null ones."""

    @F.arrow_udf("struct<language: string, confidence: double>")
    def detect(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            said, sure = [], []
            for body in part.to_pylist():
                share = profiles.posterior(body) if body is not None and len(body) >= min_chars else None
                best = None if share is None else int(share.argmax())
                good = best is not None and share[best] >= min_confidence
                said.append(profiles.languages[best] if good else None)
                sure.append(float(share[best]) if good else None)
            yield pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(sure, pa.float64())], ["language", "confidence"])

    return detect.asNondeterministic()
