"""An index of three-character runs that narrows a search for substrings to candidate rows before their texts are searched.

Stored as Parquet: `rows`, the captures with a number each, rising in every file; `counts` (gram, docs); and `postings` (gram,
block, offs: the rows number block * 2^15 + off that have it), dealt by range of (gram, block) and sorted, so a gram's are in
few files and row groups. Runs that a fifth of the rows have narrow nothing and have no postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators.search import substring_matches

#: A root is looked up by so many of its rarest runs; if even the rarest is in a larger share of the rows, texts are read instead.
GRAMS, SHARE = 3, 0.2
#: Candidates that the scan is told by number, so that pages without one are skipped, or that are broadcast; more are joined.
LITERALS, BROADCAST_ROWS = 200, 1_000_000
#: Bits of a row's number within its block.
BLOCK_BITS = 15


def grams_of(text: str | None) -> np.ndarray:
    """Distinct runs of three code points, as numbers of 63 bits, in order."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]) if len(codes) >= 3 else np.empty(0, dtype=np.int64)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, block, offs of the rows (id, t) of each batch; a gram's rows of one block may come in several."""
    for batch in batches:
        found = [grams_of(t) for t in batch.column("t").to_pylist()]
        ids = np.repeat(batch.column("id").to_numpy(), [len(g) for g in found])
        grams = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        order = np.lexsort((ids, grams))
        grams, ids = grams[order], ids[order]
        blocks = ids >> BLOCK_BITS
        starts = np.flatnonzero(np.diff(grams, prepend=-1).astype(bool) | np.diff(blocks, prepend=-1).astype(bool))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array((ids & ((1 << BLOCK_BITS) - 1)).astype(np.int16)))
        yield pa.RecordBatch.from_arrays([pa.array(grams[starts]), pa.array(blocks[starts]), lists], names=["gram", "block", "offs"])


def _any(tests: list[Column]) -> Column:
    """A balanced disjunction, which reaches the scan whole."""
    while len(tests) > 1:
        tests = [tests[k] | tests[k + 1] if k + 1 < len(tests) else tests[k] for k in range(0, len(tests), 2)]
    return tests[0]


@dataclass
class SubstringIndex:
    """All candidates are tested by their texts, so results are those of `substring_matches`, repeated rows included."""

    spark: SparkSession
    path: str
    fields: tuple[str, ...] = ("title", "text")

    def build(self, df: DataFrame) -> SubstringIndex:
        """Writes the index of all rows. Null fields are empty; runs do not go across fields."""
        df.withColumn("_id", F.monotonically_increasing_id()).write.parquet(f"{self.path}/rows")  # numbers count from here on
        joined = F.lower(F.concat_ws("\0\0", *[F.coalesce(F.col(c), F.lit("")) for c in self.fields]))
        self.rows().select(F.col("_id").alias("id"), joined.alias("t")).mapInArrow(_postings, "gram long, block long, offs array<short>").write.parquet(f"{self.path}/lists")
        lists = self.spark.read.parquet(f"{self.path}/lists")
        lists.groupBy("gram").agg(F.sum(F.size("offs")).alias("docs")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.path}/counts")
        frequent = self._counts().filter(F.col("docs") > SHARE * self.rows().count()).select("gram")
        if frequent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # at most five times the runs of a mean text; if not, theirs stay
            lists = lists.join(F.broadcast(frequent), "gram", "left_anti")
        lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{self.path}/postings")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def candidates(self, root: str) -> DataFrame | None:
        """_id of the rows that have the rarest runs of the root; None if the root is too short or its runs too frequent to narrow anything."""
        low = self.spark.range(1).select(F.lower(F.lit(root))).first()[0]
        wanted = grams_of(low).tolist()
        if not wanted:
            return None
        known = {r.gram: r.docs for r in self._counts().filter(F.col("gram").isin(wanted)).collect()}
        if len(known) < len(wanted):
            return self.spark.createDataFrame([], "_id long")
        most = SHARE * self.rows().count()
        rarest = sorted((g for g in wanted if known[g] <= most), key=lambda g: (known[g], g))[:GRAMS]
        if not rarest:
            return None
        found = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("gram").isin(rarest)).select("gram", "block", F.explode("offs").alias("off"))
        found = found.select("gram", (F.shiftleft("block", BLOCK_BITS) + F.col("off")).alias("_id"))
        return found.groupBy("_id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rarest)).select("_id")

    def matches(self, roots: list[str]) -> DataFrame:
        """Rows in which any field has any root, whatever the case: candidates first, then their texts."""
        rows, every = self.rows(), None
        for root in roots:
            found = self.candidates(root)
            if found is None:
                return substring_matches(rows, roots, self.fields).drop("_id")
            every = found if every is None else every.union(found)
        if every is None:
            return rows.limit(0).drop("_id")
        every = every.distinct()
        few = [r[0] for r in every.limit(LITERALS + 1).collect()]
        if len(few) <= LITERALS:
            rows = rows.filter(_any([F.col("_id") == k for k in few])) if few else rows.limit(0)
        else:
            bounded = every.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            rows = rows.join(F.broadcast(every) if bounded else every, "_id", "left_semi")
        return substring_matches(rows, roots, self.fields).drop("_id")
