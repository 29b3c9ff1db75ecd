"""What the training-data operators share: table reading, checkpoints, byte constants."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.session import cut, importable, shared_dir, shared_subdir, spread

__all__ = ["SPACE_CLASS", "WORD_PATTERN", "as_struct", "cut", "hold_alone", "join_by_hot_keys", "release", "remove", "shared_dir", "shared_subdir", "shuffle_partitions", "slices", "table", "text_or_empty"]

#: Characters that separate words: space and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = importable(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def as_struct(rows: DataFrame) -> Column:
    """All columns as one, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that have been cut: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of texts that a task of an operator with large tables works on at once.
SLICE_BYTES = 1 << 20
#: The operator whose tables this Python worker holds, and what empties them.
_holder: list[tuple[str, Callable[[], None]]] = []


def slices(parts: Iterator[pa.Array], size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The arrays in pieces of about `size` bytes, one row at least: objects made of a piece are gone before the next."""
    for part in parts:
        rows = max(1, len(part) * size // max(1, part.nbytes))
        for k in range(0, len(part), rows):
            yield part.slice(k, rows)


def hold_alone(name: str, empty: Callable[[], None]) -> None:
    """Called by tasks that keep tables in their worker for later tasks: those of another operator are emptied first.

    Spark's workers live on from stage to stage, so without this they hold the tables of all operators that a job has run.
    """
    if _holder and _holder[0][0] != name:
        _holder.pop()[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)
    if not _holder:
        _holder.append((name, empty))


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a table of our own in the shared folder, once what was made from it has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: A key with more than one in so many rows is hot; there are fewer such keys than this, so what they are joined with can be broadcast.
HOT_SHARE = 500


def join_by_hot_keys(rows: DataFrame, keyed: DataFrame, key: str, weight: str = "n") -> DataFrame:
    """rows joined with keyed, which has one row a key (not null) and in `weight` the number of rows of that key. Both are tables that have been cut.

    The rows of hot keys meet a broadcast of at most HOT_SHARE rows and stay where they are; all others are shuffled by key.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    hot = keyed.filter(F.col(weight) * HOT_SHARE > total)
    names = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(names, key, "left_anti").join(keyed.filter(F.col(weight) * HOT_SHARE <= total), key))
