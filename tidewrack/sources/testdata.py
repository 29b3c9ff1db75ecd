"""The driver's tables as captures: one fixed mapping, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.session import spread

ANCHOR = "2024-01-01 00:00:00"


#: Tables with texts, on which work is by the row.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def captures(spark: SparkSession, sf_dir: str, groups: bool = True) -> DataFrame:
    """documents as captures. The group of a capture is the least id with its text, found by a grouped minimum and a join; without groups it is null."""
    docs = table(spark, sf_dir, "documents").withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    if groups:
        docs = docs.join(docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_id")), "content_hash", "left")
    else:
        docs = docs.withColumn("first_id", F.lit(None).cast("long"))
    minutes = F.expr(f"timestampadd(MINUTE, cast((doc_id * 37) % 43200 as int), timestamp_ntz'{ANCHOR}')")
    key = F.col("doc_id").cast("string")
    return docs.select(
        key.alias("doc_id"),
        F.concat(F.lit("cap-"), key).alias("capture_id"),
        F.col("first_id").cast("string").alias("parent_doc_or_dup_group"),
        F.col("source").alias("source_type"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), key).alias("url"),
        F.concat(F.col("source"), F.lit(".example")).alias("domain"),
        minutes.alias("fetch_ts"),
        minutes.alias("observed_ts"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 512).alias("title"),
        "text",
        F.col("lang").alias("language"),
        "content_hash",
    )


#: A WITH list for DuckDB that ends in captures.
CAPTURES_SQL = f"""
captures AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, 'cap-' || CAST(d.doc_id AS VARCHAR) AS capture_id,
         CAST(min(d.doc_id) OVER (PARTITION BY md5(d.text)) AS VARCHAR) AS parent_doc_or_dup_group,
         d.source AS source_type, 'https://' || d.source || '.example/' || CAST(d.doc_id AS VARCHAR) AS url, d.source || '.example' AS domain,
         TIMESTAMP '{ANCHOR}' + to_minutes(CAST((d.doc_id * 37) % 43200 AS INTEGER)) AS fetch_ts,
         TIMESTAMP '{ANCHOR}' + to_minutes(CAST((d.doc_id * 37) % 43200 AS INTEGER)) AS observed_ts,
         substr(split_part(d.text, chr(10), 1), 1, 512) AS title, d.text AS text, d.lang AS language, md5(d.text) AS content_hash
  FROM documents d)"""
