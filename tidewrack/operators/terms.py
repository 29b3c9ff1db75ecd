"""Term time series, token counts, breakdowns and spikes over captures. No row caps: every count is over the whole window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.tokens import ANALYTICS_STOPWORDS, ascii_tokens, counted_tokens, matches
from tidewrack.functions.windows import bucket, calendar, checked_limit, newest, tail


def term_frequency(df: DataFrame, term: str, days: int = 7, granularity: str = "day", mode: str = "title_text") -> DataFrame:
    """bucket, count: documents with the term in each bucket of the tail window, zeros included."""
    end = newest(df)
    hits = tail(df, days, end=end).filter(matches(term, mode))
    counts = hits.groupBy(bucket(F.col("fetch_ts"), granularity).alias("bucket")).agg(F.count("*").alias("n"))
    return calendar(df, days, granularity=granularity, end=end).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def terms_frequency(df: DataFrame, terms: list[str], days: int = 7, granularity: str = "day", mode: str = "title_text") -> DataFrame:
    """term, bucket, count for many terms in one scan: a conditional count for each term, then a row each."""
    end = newest(df)
    part = tail(df, days, end=end)
    counts = part.groupBy(bucket(F.col("fetch_ts"), granularity).alias("bucket")).agg(*[F.count(F.when(matches(t, mode), True)).alias(f"n{k}") for k, t in enumerate(terms)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.coalesce(F.col(f"n{k}"), F.lit(0)).cast("long").alias("count")) for k, t in enumerate(terms)]))
    return calendar(df, days, granularity=granularity, end=end).join(counts, "bucket", "left").select("bucket", rows.alias("r")).select("r.term", "bucket", "r.count")


def top_terms(df: DataFrame, limit: int = 50, min_count: int = 2, days: int | None = None) -> DataFrame:
    """term, count: occurrences of tokens of two characters and more that are no stopwords, most frequent first."""
    part = tail(df, days) if days else df
    counts = counted_tokens(part.select(ascii_tokens(F.col("text")).alias("tokens")), 2, ANALYTICS_STOPWORDS).filter(F.col("count") >= min_count)
    return counts.orderBy(F.desc("count"), "term").limit(checked_limit(limit))


def co_occurring(df: DataFrame, term: str, limit: int = 50, min_count: int = 2) -> DataFrame:
    """Tokens of the texts that have the term, but for the term itself."""
    words = df.filter(matches(term)).select(ascii_tokens(F.col("text")).alias("tokens"))
    counts = counted_tokens(words, 2, ANALYTICS_STOPWORDS).filter((F.col("count") >= min_count) & (F.col("term") != term.strip().lower()))
    return counts.orderBy(F.desc("count"), "term").limit(checked_limit(limit))


def spikes(df: DataFrame, term: str, days: int = 14, threshold: float = 2.5, min_absolute: int = 3) -> DataFrame:
    """bucket, count, zscore of the days whose count stands out (sample standard deviation); needs three days. The series has a row a day."""
    series = term_frequency(df, term, days)
    whole = Window.partitionBy(F.lit(0))
    scored = series.withColumn("mean", F.avg("count").over(whole)).withColumn("std", F.stddev_samp("count").over(whole)).withColumn("n", F.count("*").over(whole))
    scored = scored.filter("n >= 3 AND std > 0").withColumn("zscore", (F.col("count") - F.col("mean")) / F.col("std"))
    return scored.filter((F.col("zscore") >= threshold) & (F.col("count") >= min_absolute)).select("bucket", "count", F.round("zscore", 4).alias("zscore"))


def zscores(series: DataFrame) -> DataFrame:
    """series: bucket, count. Adds zscore, 0 for a flat series."""
    whole = Window.partitionBy(F.lit(0))
    std = F.stddev_samp("count").over(whole)
    return series.withColumn("zscore", F.round(F.coalesce(F.when(std > 0, (F.col("count") - F.avg("count").over(whole)) / std), F.lit(0.0)), 4))


def domain_breakdown(df: DataFrame, limit: int = 20) -> DataFrame:
    part = df.filter(F.col("domain").isNotNull() & (F.trim("domain") != ""))
    return part.groupBy("domain").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "domain").limit(checked_limit(limit))


def primary_language(column: str = "language"):
    return F.split_part(F.lower(F.replace(F.col(column), F.lit("_"), F.lit("-"))), F.lit("-"), F.lit(1))


def language_breakdown(df: DataFrame, limit: int = 20) -> DataFrame:
    """By primary subtag; a null language is a row of its own."""
    counts = df.groupBy(primary_language().alias("language")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.col("language").asc_nulls_last()).limit(checked_limit(limit))
