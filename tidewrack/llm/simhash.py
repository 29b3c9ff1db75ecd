"""SimHash near-duplicates, linked by an exact tiled comparison.

Fingerprints of 64 bits are taken from word shingles in numpy. Two fingerprints that differ in at most `radius` bits
agree on all but `radius` of any blocks that the 64 bits are cut into, so each fingerprint is dealt to one bucket for
every choice of blocks that may agree; the number of blocks grows with the number of distinct fingerprints, which
keeps buckets small at any size. Inside a bucket, fingerprints are ordered by population count, cut into tiles and
compared exactly (exclusive-or and bit counts in numpy); a pair of tiles whose population counts lie further apart
than the radius is skipped. A bucket too large for one task is dealt as pairs of blocks of rows to many tasks. Tiles
yield a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewrack.llm.common import as_struct, cut, join_by_hot_keys, shared_subdir, shuffle_partitions, text_or_empty
from tidewrack.llm.components import connected_components

WORDS = 4
SEED = 42
RADIUS = 4
#: Rows of one side that a task compares at most, and rows of a numpy tile inside it.
PART_ROWS = 4096
TILE_ROWS = 512
#: Mean rows of a bucket above which fingerprints are cut into one block more.
BUCKET_ROWS = 1024

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64)


def fingerprint(text: bytes, width: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    hashes = _shingle_hashes(words, width, seed)
    rows = hashes.view(np.uint8).reshape(-1, 8)
    if len(rows) < 400:
        counts = np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    bits = np.packbits(2 * counts > len(rows), bitorder="little")
    return int(bits.view(np.int64)[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in texts:
        yield pa.array([fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in part.cast(pa.large_binary())], type=pa.int64())


def fingerprint_column(name: str = "text") -> Column:
    return _fingerprints(text_or_empty(name))


def agreeing_masks(distinct: int, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree under one of them at least."""
    blocks = radius + 1
    while blocks < radius + 5 and distinct / 2 ** ((blocks - radius) * 64 // blocks) > bucket_rows:
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


class _Forest:
    """Union-find over the rows of a bucket, joined by arrays of linked rows."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            best = np.arange(len(self.root))
            np.minimum.at(best, high, low)
            while True:
                further = best[best]
                if (further == best).all():
                    break
                best = further
            self.root = best[self.root]


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)


def tile_links(values: np.ndarray, side: np.ndarray, radius: int = RADIUS, tile: int = TILE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among distinct uint64 values. side: 0 for one set, or 0 and 1 for two sets of which only pairs across count."""
    order = np.argsort(np.bitwise_count(values), kind="stable")
    values, side = values[order], side[order]
    split = bool(side.any())
    sets = [np.flatnonzero(side == k) for k in ((0, 1) if split else (0,))]
    counts = np.bitwise_count(values).astype(np.int64)
    forest = _Forest(len(values))
    tiles = [[rows[k : k + tile] for k in range(0, len(rows), tile)] for rows in sets]
    for i, left in enumerate(tiles[0]):
        for j, right in enumerate(tiles[-1]):
            if not split and j < i:
                continue
            if counts[right[0]] - counts[left[-1]] > radius or counts[left[0]] - counts[right[-1]] > radius:
                continue
            for k in range(0, len(left), 64):
                some = left[k : k + 64]
                a, b = _near(values[some], values[right], radius)
                forest.link(some[a], right[b])
    moved = np.flatnonzero(forest.root != np.arange(len(values)))
    return values[moved], values[forest.root[moved]]


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by bucket and pair of parts; what is kept between batches is one such pair, of bounded size."""
        held: list[np.ndarray] = []
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def links(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            values, first = np.unique(rows[:, 4], return_index=True)
            return tile_links(values.view(np.uint64), rows[first, 5], radius)

        def emit(found: list) -> Iterator[pa.RecordBatch]:
            if found:
                u = np.concatenate([x[0] for x in found]).view(np.int64)
                v = np.concatenate([x[1] for x in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], axis=1)
            rows = np.concatenate([*held, rows]) if held else rows
            if not len(rows):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]))
            held = [rows[starts[-1] :]]
            sizes = np.diff(starts)
            yield from emit([links(rows[a : a + n]) for a, n in zip(starts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist())])
        if held and len(held[0]) > 1:
            yield from emit([links(held[0])])

    return run


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """nodes: distinct long fingerprints in column fp. Returns links (u, v) that connect all that lie within the radius."""
    masks = agreeing_masks(nodes.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])).alias("at"))
    dealt = dealt.select("at.choice", "at.key", "fp")
    large = dealt.groupBy("choice", "key").count().filter(F.col("count") > part_rows)
    large = large.select("choice", "key", F.ceil(F.col("count") / part_rows).cast("long").alias("parts"))
    dealt = dealt.join(large, ["choice", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = dealt.withColumn("own", own).withColumn("pair", F.explode(pairs))
    dealt = dealt.select("choice", "key", "pair.i", "pair.j", "fp", (F.col("own") > F.col("pair.i")).cast("int").alias("side"))
    ordered = dealt.repartition(shuffle_partitions(nodes.sparkSession), "choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j")
    return ordered.mapInArrow(_bucket_links(radius), "u long, v long").distinct()


def near_duplicate_classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: (doc_id, fp), computed once. Returns (fp, component_id): the smallest doc_id that can be reached from fp.

    Null ids are passed over; a component of null ids alone has a null component_id. Repeated ids are one node each time.
    """
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    labels = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    return join_by_hot_keys(rooted, labels, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    A null text counts as empty. Texts without words have fingerprint zero and are linked like any other.
    Repeated rows are all returned. Columns beyond doc_id and text are ignored.
    """
    fps = cut(docs.select("doc_id", fingerprint_column("text").alias("fp")))
    classes = near_duplicate_classes(fps, radius)
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without all but one of each group of near-duplicates: that with the least doc_id, nulls last.

    Of repeated rows one stays. docs may be read in any order: rows are numbered and fingerprinted once, in a table in the
    shared folder that both the decisions and the result are read from; each row is one column there, so its own columns
    may have any names, and are returned as they are.
    """
    spark = docs.sparkSession
    folder = shared_subdir(spark, "numbered")
    docs.select(as_struct(docs).alias("doc"), F.monotonically_increasing_id().alias("row"), fingerprint_column("text").alias("fp")).write.parquet(folder)
    placed = spark.read.parquet(folder)
    nodes = placed.groupBy("fp").agg(F.min(F.struct(F.col("doc.doc_id").isNull().alias("missing"), F.col("doc.doc_id").alias("doc_id"), "row")).alias("first"))
    nodes = cut(nodes)
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = cut(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.row"))
    return placed.join(kept, "row", "left_semi").select("doc.*")
