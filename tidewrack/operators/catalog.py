"""Listings, lookups and counts over captures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.text import language_filter
from tidewrack.functions.windows import checked_limit, inclusive_end
from tidewrack.operators.terms import primary_language


def run_sql(spark: SparkSession, captures: DataFrame, sql: str, args: dict | None = None) -> DataFrame:
    """Any SQL over captures, with named parameters."""
    captures.createOrReplaceTempView("captures")
    return spark.sql(sql, args=args or {})


def latest_captures(df: DataFrame) -> DataFrame:
    """One row for each capture_id, the newest fetch_ts; as a grouped maximum, which is combined before the shuffle."""
    rest = [c for c in df.columns if c not in ("capture_id", "fetch_ts")]
    newest = df.groupBy("capture_id").agg(F.max_by(F.struct("fetch_ts", *rest), F.struct(F.col("fetch_ts").isNotNull(), "fetch_ts", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id",) if c in rest])).alias("r"))
    return newest.select("capture_id", "r.*").select(*df.columns)


def fold_key(unique: str) -> Column:
    """What rows are folded by: content prefers the hash, group the duplicate group."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    keys = {"content": ["content_hash", "capture_id"], "group": ["parent_doc_or_dup_group", "content_hash", "capture_id"]}
    names = keys[unique]
    return F.coalesce(*[blank(n) for n in names[:-1]], F.col(names[-1]))


def first_of_each(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """Of the rows of each key the least by order and capture_id; all of order are compared ascending, nulls first.

    The least of a key is a grouped minimum of small structs, which is combined before the shuffle; rows are joined to it by
    key and capture_id, so a key that very many rows have is dealt over many tasks, and no whole rows are sorted.
    """
    rows = df.withColumn("__key", key).withColumn("__order", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col("capture_id").isNull().alias("none"), F.col("capture_id").alias("id")))
    least = rows.groupBy("__key").agg(F.min("__order").alias("__least")).select(F.col("__key").alias("__k"), "__least")
    same = rows["__key"].eqNullSafe(least["__k"]) & rows["__order"]["id"].eqNullSafe(least["__least"]["id"]) & rows["__order"].eqNullSafe(least["__least"])
    return rows.join(least, same).dropDuplicates(["__key", "__order"]).drop("__key", "__order", "__k", "__least")


def folded(df: DataFrame, unique: str = "none", newest: bool = True, time: Column | None = None) -> DataFrame:
    """One row of each fold: the newest (or earliest) by time, rows without a time last, ties by capture_id."""
    if unique == "none":
        return df
    time = F.col("fetch_ts") if time is None else time
    micros = F.unix_micros(time.cast("timestamp"))
    return first_of_each(df, fold_key(unique), time.isNull(), -micros if newest else micros)


def filtered(df: DataFrame, start: datetime | None = None, end: datetime | None = None, domain: str | None = None, source: str | None = None, language: str | None = None, query: str | None = None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("fetch_ts") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("fetch_ts") <= F.lit(inclusive_end(end)))
    if domain:
        df = df.filter(F.lower("domain") == domain.lower())
    if source:
        df = df.filter(F.lower("source_type") == source.lower())
    if language:
        df = df.filter(language_filter(language))
    if query:
        like = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        df = df.filter(F.col("title").ilike(like) | F.col("text").ilike(like))
    return df


def listing(df: DataFrame, limit: int = 50, offset: int = 0, unique: str = "none") -> DataFrame:
    """A page, newest first."""
    return folded(df, unique).orderBy(F.col("fetch_ts").desc_nulls_last(), "capture_id").offset(max(0, offset)).limit(checked_limit(limit))


def counts(df: DataFrame) -> DataFrame:
    """kind, key, count by source type, domain and primary language in one pass of grouping sets, with the total."""
    rows = df.select(F.col("source_type").alias("s"), F.col("domain").alias("d"), primary_language().alias("l"))
    sets = rows.groupingSets([["s"], ["d"], ["l"], []], "s", "d", "l").agg(F.count("*").alias("count"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "source").when(F.col("g") == 5, "domain").when(F.col("g") == 6, "language").otherwise("total")
    key = F.when(F.col("g") == 3, F.col("s")).when(F.col("g") == 5, F.col("d")).when(F.col("g") == 6, F.col("l"))
    return sets.select(kind.alias("kind"), key.alias("key"), "count")


def related(df: DataFrame, capture_id: str, limit: int = 12) -> DataFrame:
    """Captures of the same duplicate group, or whose document is its root, newest first."""
    one = df.filter(F.col("capture_id") == capture_id).select(F.coalesce(F.nullif(F.trim("parent_doc_or_dup_group"), F.lit("")), "doc_id").alias("root")).limit(1)
    rows = df.join(F.broadcast(one), (F.col("parent_doc_or_dup_group") == F.col("root")) | (F.col("doc_id") == F.col("root"))).filter(F.col("capture_id") != capture_id).drop("root")
    return rows.orderBy(F.col("fetch_ts").desc_nulls_last(), "capture_id").limit(checked_limit(limit))


def related_counts(df: DataFrame) -> DataFrame:
    """capture_id, related: the siblings of each capture in its group."""
    sizes = df.filter(F.col("parent_doc_or_dup_group").isNotNull()).groupBy("parent_doc_or_dup_group").agg(F.count("*").alias("n"))
    return df.join(sizes, "parent_doc_or_dup_group", "left").select("capture_id", (F.coalesce("n", F.lit(1)) - 1).alias("related"))


def upserted(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows of fresh that stored has not: an anti-join by capture_id."""
    return fresh.join(stored.select("capture_id"), "capture_id", "left_anti")


def conflicts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """capture_ids that both have, with contents that differ; nulls equal nulls."""
    s = stored.select("capture_id", *[F.col(c).alias(f"__{c}") for c in stored.columns if c != "capture_id"])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in stored.columns if c != "capture_id"]
    equal = same[0]
    for x in same[1:]:
        equal = equal & x
    return fresh.join(s, "capture_id").filter(~equal).select("capture_id")


def sampled(df: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(checked_limit(n, 1000))
