"""How common shingles are in a corpus, in a count-min sketch of fixed size, as weights of signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.hashing import hashedshingles, weighted_signature

BITS, DEPTH = 18, 4
#: Counters that are added up together: a group has one such piece from each task.
PIECE = 256


def cells_of(h1: np.ndarray, h2: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """depth x n places of hashed shingles, one in each row of the sketch."""
    turns = np.arange(depth, dtype=np.uint64)[:, None]
    return ((h1 + turns * (h2 | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class CorpusWeights:
    """counts: depth x 2^bits numbers of documents; docs: how many were counted."""

    counts: np.ndarray
    docs: int

    def frequency(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents that have each shingle: never too few; too many by 2^-bits of e times all shingles, with a chance of e^-depth."""
        depth, width = self.counts.shape
        places = cells_of(h1, h2, width.bit_length() - 1, depth)
        return self.counts[np.arange(depth)[:, None], places].min(axis=0)

    def weight(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """1 + ln((1 + docs) / (1 + frequency)): 1 for what all documents have."""
        return 1 + np.log((1 + self.docs) / (1 + np.minimum(self.frequency(h1, h2), self.docs)))


def learn(df: DataFrame, normal: Column, width: int = 3, bits: int = BITS, depth: int = DEPTH) -> CorpusWeights:
    """Counts the documents of each shingle of the normalized texts; texts that are null or have no words are not counted.

    A task keeps one sketch (8 MB) and sends it in pieces; the sum, of the same size, goes to the driver.
    """
    whole = depth << bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, docs = np.zeros(whole, dtype=np.int64), 0
        rows = (np.arange(depth, dtype=np.int64) << bits)[:, None]
        for batch in batches:
            for h1, h2 in hashedshingles(batch.column("t").to_pylist(), width):
                if len(h1):
                    _, first = np.unique(h1, return_index=True)
                    np.add.at(sketch, (cells_of(h1[first], h2[first], bits, depth) + rows).ravel(), 1)
                    docs += 1
        parts = sketch.reshape(-1, min(PIECE, whole))
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([np.int64(docs).tobytes(), *(parts[k].tobytes() for k in used)], pa.binary())], names=["piece", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("counts"))
        return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    pieces = df.select(normal.alias("t")).mapInArrow(counted, "piece int, counts binary").groupBy("piece").applyInArrow(added, "piece int, counts binary").toArrow()
    sums, docs = np.zeros((whole // min(PIECE, whole), min(PIECE, whole)), dtype=np.int64), 0
    for piece, counts in zip(pieces.column("piece").to_pylist(), pieces.column("counts").to_pylist()):
        values = np.frombuffer(counts, dtype=np.int64)
        if piece < 0:
            docs = int(values[0])
        else:
            sums[piece] = values
    return CorpusWeights(sums.reshape(depth, 1 << bits), docs)


def weighted_signatures_of(weights: CorpusWeights):
    """Normalized texts -> struct(hi, lo): 128-bit signatures, each distinct shingle weighted by its number in the text and by how rare it is in the corpus."""

    @F.arrow_udf("struct<hi: bigint, lo: bigint>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            found = [weighted_signature(a, b, weights.weight) if len(a) else (None, None) for a, b in hashedshingles(part.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], ["hi", "lo"])

    return run.asNondeterministic()
