"""Corpus quality: topic matrix, snapshot, history, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.tokens import matches
from tidewrack.functions.windows import bucket, checked_limit, newest, pruned, tail
from tidewrack.operators.sources import named
from tidewrack.operators.terms import domain_breakdown, language_breakdown
from tidewrack.session import cut


def topic_matrix(df: DataFrame, terms: list[str], days: int = 30, top_domains: int = 20) -> DataFrame:
    """term, domain, count, domain_total: documents with each term by each of the largest domains, zeros included, in one scan."""
    part = named(tail(df, days), "trim")
    rows = part.groupBy("domain").agg(F.count("*").alias("domain_total"), *[F.count(F.when(matches(t), True)).alias(f"n{k}") for k, t in enumerate(terms)])
    rows = rows.orderBy(F.desc("domain_total"), "domain").limit(checked_limit(top_domains))
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"n{k}").alias("count")) for k, t in enumerate(terms)]))
    return rows.select("domain", "domain_total", cells.alias("c")).select("c.term", "domain", "c.count", "domain_total")


def _present(name: str) -> Column:
    return F.col(name).isNotNull() & (F.trim(name) != "")


def _repeated(df: DataFrame, key: str, within: Column | None = None, extra: Column | None = None) -> DataFrame:
    """bucket (within, or null), n: rows whose key another capture (of the bucket) has, if extra holds for them. Two sums, no join: no group meets in one task."""
    part = df.filter(_present(key)).withColumn("bucket", F.lit(None).cast("date") if within is None else within)
    counts = part.groupBy(key, "bucket").agg(F.min("capture_id").alias("a"), F.max("capture_id").alias("b"), (F.count("*") if extra is None else F.count_if(extra)).alias("n"))
    return counts.filter("a <> b").groupBy("bucket").agg(F.sum("n").alias("n"))


def quality_snapshot(df: DataFrame, days: int | None = None) -> DataFrame:
    """One row: totals, empty texts, duplicate ratios, average length, groups and rate a day. Zeros for an empty table."""
    part = tail(df, days) if days else df
    main = part.agg(F.count("*").alias("total"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty_text"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("avg"), ((F.unix_seconds(F.max("fetch_ts").cast("timestamp")) - F.unix_seconds(F.min("fetch_ts").cast("timestamp"))) / 86400).alias("span"))
    dup = _repeated(part, "content_hash").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dup"))
    near = _repeated(part, "parent_doc_or_dup_group", extra=F.col("parent_doc_or_dup_group") != F.col("doc_id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("near"))
    groups = part.filter(_present("parent_doc_or_dup_group")).groupBy("parent_doc_or_dup_group").count().filter("count >= 2").agg(F.count("*").alias("groups"))
    one = main.crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(near)).crossJoin(F.broadcast(groups))  # single rows
    ratio = lambda c: F.round(F.coalesce(F.col(c) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6)
    return one.select(F.col("total").alias("total_captures"), "empty_text", ratio("dup").alias("duplicate_ratio"), ratio("near").alias("near_duplicate_ratio"), F.round(F.coalesce("avg", F.lit(0.0)), 4).alias("avg_length"), F.col("groups").alias("dedup_group_count"), F.round(F.when(F.col("span") > 0, F.col("total") / F.col("span")).otherwise(F.lit(0.0)), 4).alias("capture_rate_per_day"))


def snapshot_languages(df: DataFrame) -> DataFrame:
    return language_breakdown(df, 10).select(F.when(F.col("language").isNull() | (F.trim("language") == ""), "unknown").otherwise(F.col("language")).alias("language"), "count")


def snapshot_domains(df: DataFrame) -> DataFrame:
    return domain_breakdown(df, 10)


def quality_history(df: DataFrame, days: int = 30, granularity: str = "day") -> DataFrame:
    """bucket, total, duplicate_ratio, near_duplicate_ratio, avg_length, new_domains, capture_rate; ratios inside each bucket, zeros included."""
    end = F.to_date(newest(df))
    start = F.date_sub(end, days - 1)
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[granularity]
    cal = df.sparkSession.range(1).select(F.explode(F.sequence(bucket(start, granularity), bucket(end, granularity), F.expr(step))).alias("bucket"))
    part = pruned(df, start.cast(df.schema["fetch_ts"].dataType), None)
    # read once: three counts need these few columns, and texts only as lengths
    part = cut(part.select("capture_id", "doc_id", "content_hash", "parent_doc_or_dup_group", bucket(F.col("fetch_ts"), granularity).alias("key"), F.length(F.coalesce("text", F.lit(""))).alias("chars")))
    key = F.col("key")
    total = part.groupBy(key.alias("bucket")).agg(F.count("*").alias("total"), F.avg("chars").alias("avg_length"))
    dup = _repeated(part, "content_hash", key).withColumnRenamed("n", "dup")
    near = _repeated(part, "parent_doc_or_dup_group", key, F.col("parent_doc_or_dup_group") != F.col("doc_id")).withColumnRenamed("n", "near")
    first = named(df, "trim").groupBy("domain").agg(F.min("fetch_ts").alias("first")).filter(F.to_date("first") >= start)
    new = first.groupBy(bucket(F.col("first"), granularity).alias("bucket")).agg(F.count("*").alias("new_domains"))
    span = F.lit(1) if granularity == "day" else F.lit(7) if granularity == "week" else F.day(F.last_day("bucket"))
    rows = cal.join(total, "bucket", "left").join(dup, "bucket", "left").join(near, "bucket", "left").join(new, "bucket", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda c: F.round(F.coalesce(zero(c) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6)
    return rows.select("bucket", zero("total").alias("total"), ratio("dup").alias("duplicate_ratio"), ratio("near").alias("near_duplicate_ratio"), F.round(F.coalesce("avg_length", F.lit(0.0)), 4).alias("avg_length"), zero("new_domains").alias("new_domains"), F.round(zero("total") / span, 4).alias("capture_rate"))


def record_snapshot(snapshot: DataFrame, path: str, at: Column) -> None:
    """Appends a one-row snapshot to a history of JSON lines, with its time."""
    snapshot.withColumn("recorded_at", at).coalesce(1).write.mode("append").json(path)


def recorded_snapshots(spark: SparkSession, path: str, columns: str, since: Column | None = None) -> DataFrame:
    """The history, oldest first; columns is its schema. Lines that can't be read are passed over."""
    rows = spark.read.schema(columns + ", recorded_at string").option("mode", "DROPMALFORMED").json(path)
    rows = rows.withColumn("recorded_at", F.col("recorded_at").try_cast("timestamp_ntz")).filter("recorded_at IS NOT NULL")
    return (rows if since is None else rows.filter(F.col("recorded_at") >= since)).orderBy("recorded_at")


def hash_multiplicity(df: DataFrame, limit: int = 20) -> DataFrame:
    rows = df.filter(_present("content_hash")).groupBy("content_hash").agg(F.count("*").alias("copies")).filter("copies > 1")
    return rows.orderBy(F.desc("copies"), "content_hash").limit(checked_limit(limit))


def audit(df: DataFrame, short: int = 200) -> DataFrame:
    """One row of shares: empty titles, short texts, missing domains, hash duplicates."""
    n = F.count("*")
    share = lambda c: F.round(F.coalesce(F.count_if(c) / F.nullif(n, F.lit(0)), F.lit(0.0)), 6)
    return df.agg(n.alias("rows"), share(~F.coalesce(_present("title"), F.lit(False))).alias("empty_title"), share(F.length(F.coalesce("text", F.lit(""))) < short).alias("short_text"), share(~F.coalesce(_present("domain"), F.lit(False))).alias("missing_domain"), F.round(1 - F.count_distinct("content_hash") / F.nullif(F.count("content_hash"), F.lit(0)), 6).alias("hash_duplicates"))
