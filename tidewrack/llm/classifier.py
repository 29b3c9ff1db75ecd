"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is a sequence of words and marks. Features are hashed one- and two-grams of the words in lower case and one-,
two- and three-grams of their shapes (letter case, digits, which mark, whether the word was among the last few), each
counted and divided by the number of words. A score is the sparse dot product of these with the weights, through the
logistic function. Labels enter only through the training sample; language, source and id never.

The sample is bounded: the SAMPLE_ROWS labelled rows that come first by a hash of their id, out of all that may be
learnt from. Its ids are few enough to be broadcast, so the documents are not shuffled. One task trains on it, and a
weight vector of fixed size goes back to the executors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import hold_alone, slices, text_or_empty

#: Rows that are learnt from at most, and characters of them together.
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 40_000_000
HASH_BITS = 18
EPOCHS = 4
THRESHOLD = 0.3
FOLDS = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-4
KEPT_WORDS = 200_000

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_SIZE = 1 << HASH_BITS
_MASK = np.uint64(_SIZE - 1)


def _shape(word: str) -> str:
    if word.isdigit():
        return "9"
    if not word[0].isalnum() and word[0] != "_":
        return word[:4]
    case = "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a" if word.islower() else "aA"
    return f"{case}{min(len(word), 8) // 3}"


class _Words(dict):
    """Two hashes of each word seen: of itself in lower case, and of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        got = (xxhash.xxh64_intdigest(word.lower().encode("utf-8", "replace"), 1), xxhash.xxh64_intdigest(_shape(word).encode("utf-8", "replace"), 2))
        if len(self) > KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


_words = _Words()


def _forget() -> None:
    """A function of the module, so that it comes to the worker's own table; a closure would bring its copy of the driver's."""
    _words.clear()


_PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _fold(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _PRIMES[2]
    return (h >> np.uint64(40)) & _MASK


def features(text: str) -> np.ndarray:
    """The hashed features of a text, repeats included; a text without words or marks has one feature of its own."""
    tokens = _TOKENS.findall(text)
    if not tokens:
        return np.array([0], dtype=np.int64)
    pairs = np.array([_words[t] for t in tokens], dtype=np.uint64)
    word, shape = pairs[:, 0], pairs[:, 1]
    again = np.zeros(len(word), dtype=bool)
    for back in (1, 2, 3):
        again[back:] |= word[back:] == word[:-back]
    shape = shape + again.astype(np.uint64) * _PRIMES[3]
    parts = [word, shape * _PRIMES[0]]
    if len(word) > 1:
        parts += [word[:-1] * _PRIMES[1] + word[1:], shape[:-1] * _PRIMES[1] + shape[1:]]
    if len(word) > 2:
        parts.append((shape[:-2] * _PRIMES[1] + shape[1:-1]) * _PRIMES[3] + shape[2:])
    return _fold(np.concatenate(parts)).astype(np.int64)


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def score(text: str, weights: np.ndarray) -> float:
    """weights: one a feature, and the bias last."""
    found = features(text)
    return _logistic(5 * float(weights[found].sum()) / len(found) + float(weights[-1]))


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (text, label) rows, in their order. Without rows of both labels the weights are the bias alone."""
    z, n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)
    samples = []
    for text, label in rows:
        found = features(text)
        index, counts = np.unique(found, return_counts=True)
        samples.append((index.astype(np.int32), counts.astype(np.int32), len(found), label))  # small numbers, as all are held at once
    for _ in range(epochs if samples else 0):
        for index, counts, size, label in samples:
            index, value = np.append(index, _SIZE), np.append(5 * counts / size, 1.0)
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (_logistic(float(w @ value)) - label) * value
            grown = ni + g * g
            z[index] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[index] = grown
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def held_out(name: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is not held out, and has no label to learn from."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, label): labelled rows that are not held out, the first `rows` by a hash of the id, as far as their texts together have `chars` characters; the first at least.

    Repeated labels of an id count once, by their least, and of repeated rows of an id the least text is taken.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over `rows` rows at most
    sized = found.withColumn("upto", F.sum(F.length("text")).over(order)).withColumn("place", F.row_number().over(order))
    return sized.filter((F.col("upto") <= chars) | (F.col("place") == 1)).select("doc_id", "text", "label")


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_alone("classifier", _forget)
    rows = [r for batch in batches for r in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("label").to_pylist())]
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[1]))
    weights = train([(text, label) for _, text, label in rows])
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], type=pa.binary())], names=["weights"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> np.ndarray:
    """The weights; only they, of fixed size, reach the driver. The documents are read by many tasks, the sample goes to one."""
    got = training_sample(docs, labels, rows, chars).repartition(1).mapInArrow(_trainer, "weights binary").first()
    return np.frombuffer(bytes(got[0]), dtype=np.float32) if got else train([])


def score_column(weights: np.ndarray, name: str = "text") -> Column:
    sent = weights.tobytes()

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hold_alone("classifier", _forget)
        w = np.frombuffer(sent, dtype=np.float32)
        for part in slices(parts):
            yield pa.array([score(x or "", w) for x in part.to_pylist()], type=pa.float64())

    return scored(text_or_empty(name))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    A null or empty text is scored as one without words; repeated rows are scored alike, texts may be of any length, and an
    empty table gives an empty one. Other columns are ignored.
    """
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(fit(docs, labels, rows)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that are predicted to be good, as they are; repeated rows are judged alike, an empty table stays empty."""
    return docs.filter(score_column(fit(docs, labels, rows)) >= THRESHOLD)
