"""Reading and repairing captures kept as JSON lines, and Parquet tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.schema import CAPTURES, RAW_CAPTURES


def repaired(raw: DataFrame) -> DataFrame:
    """The captures schema: absent columns are nulls, times and numbers that can't be read are nulls."""
    have = {c.lower(): c for c in raw.columns}
    columns = []
    for f in CAPTURES:
        if f.name not in have:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value = F.col(have[f.name])
        if isinstance(f.dataType, T.TimestampType):
            value = F.regexp_replace(value.cast("string"), r"(\.\d{6})\d+", "$1").try_cast("timestamp")
        elif not isinstance(f.dataType, T.StringType):
            value = value.cast("string").try_cast(f.dataType)
        columns.append(value.alias(f.name))
    return raw.select(*columns)


_FILES = {"recursiveFileLookup": True, "pathGlobFilter": "*.jsonl{,.gz}", "ignoreCorruptFiles": True}


def read_jsonl(spark: SparkSession, root: str) -> DataFrame:
    """All *.jsonl and *.jsonl.gz files below root; writers' temporary files are not read, corrupt lines and files are passed over."""
    raw = spark.read.schema(RAW_CAPTURES).options(mode="PERMISSIVE", **_FILES).json(root)
    return repaired(raw).filter(F.col("capture_id").isNotNull())


def bad_records(spark: SparkSession, root: str) -> DataFrame:
    """path, value of the lines that are no JSON, for a dead-letter table."""
    lines = spark.read.options(**_FILES).text(root).select(F.input_file_name().alias("path"), "value")
    return lines.filter((F.trim("value") != "") & F.try_parse_json("value").isNull())


def union_captures(*tables: DataFrame) -> DataFrame:
    """Tables by column name; what one lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned Parquet table of captures."""
    return spark.read.parquet(path)


def fixture(spark: SparkSession, rows: list[dict], min_chars: int = 50) -> DataFrame:
    """Captures from Python rows, for tests; short texts are left out."""
    raw = spark.createDataFrame([{f.name: None if r.get(f.name) is None else str(r[f.name]) for f in CAPTURES} for r in rows], RAW_CAPTURES)
    return repaired(raw).filter(F.length(F.trim("text")) >= min_chars)
