"""Joins with other series: external article counts and short-message sessions."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.lexicon import DEFAULT, Lexicon
from tidewrack.functions.tokens import ascii_tokens
from tidewrack.functions.windows import checked_limit
from tidewrack.operators.sentiment import tweet_class, tweet_score, with_tweet_hits
from tidewrack.operators.terms import term_frequency

GAP_LEAST, GAP_RATIO = 25, 0.1


def flat_safe_corr(x: str, y: str) -> Column:
    """Pearson's r; 0 for less than two rows or a flat series."""
    return F.coalesce(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), F.lit(0.0))


def compared(local: DataFrame, external: DataFrame) -> DataFrame:
    """local, external: (bucket, count). One row: r, days, and both totals; missing days are zeros."""
    both = local.withColumnRenamed("count", "x").join(external.withColumnRenamed("count", "y"), "bucket", "full").fillna(0, ["x", "y"])
    return both.agg(F.round(flat_safe_corr("x", "y"), 4).alias("r"), F.count("*").alias("days"), F.sum("x").alias("local_total"), F.sum("y").alias("external_total"))


def rebucketed(series: DataFrame, bucket_of: Column) -> DataFrame:
    """series: bucket, count, truncated."""
    return series.groupBy(bucket_of.alias("bucket")).agg(F.sum("count").alias("count"), F.bool_or("truncated").alias("truncated"))


def coverage_gaps(local: DataFrame, external: DataFrame) -> DataFrame:
    """local, external: (term, count). A gap is much outside and little here."""
    both = external.withColumnRenamed("count", "external").join(local.withColumnRenamed("count", "local"), "term", "left").fillna(0, ["local"])
    gap = (F.col("external") >= GAP_LEAST) & (F.col("local") / F.nullif(F.col("external"), F.lit(0)) < GAP_RATIO)
    return both.select("term", "local", "external", F.coalesce(gap, F.lit(False)).alias("gap"))


def lagged_correlation(df: DataFrame, a: str, b: str, days: int = 30, lags: int = 3) -> DataFrame:
    """lag, r: daily counts of two terms, shifted; a positive lag compares a with earlier b. best marks the largest |r|, the least |lag| on ties."""
    numbered = lambda t, n: term_frequency(df, t, days).select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bucket")).alias("k"), F.col("count").alias(n))
    spark = df.sparkSession
    shifts = spark.range(-lags, lags + 1).select(F.col("id").alias("lag"))
    x, y = numbered(a, "x"), numbered(b, "y")
    rows = x.join(F.broadcast(shifts)).withColumn("k", F.col("k") - F.col("lag")).join(y, "k")
    r = rows.groupBy("lag").agg(F.round(flat_safe_corr("x", "y"), 4).alias("r"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("r")), F.abs("lag"), "lag")
    return r.withColumn("best", F.row_number().over(w) == 1)


def joint_correlation(both: DataFrame, x: str, y: str) -> DataFrame:
    """Over rows where both are not zero; null for fewer than three."""
    return both.filter((F.col(x) != 0) & (F.col(y) != 0)).agg(F.when(F.count("*") >= 3, F.round(flat_safe_corr(x, y), 4)).alias("r"))


def verdict(news: Column, other: Column) -> Column:
    return F.when((news == 0) | (other == 0), "neutral").when(F.signum(news) == F.signum(other), "converging").otherwise("diverging")


def combined(news: DataFrame, messages: DataFrame) -> DataFrame:
    """news: bucket, avg_score; messages: bucket, score. Day by day, then one verdict in every row."""
    both = news.select("bucket", F.col("avg_score").alias("news")).join(messages.select("bucket", F.col("score").alias("other")), "bucket", "full").fillna(0.0, ["news", "other"])
    w = Window.partitionBy(F.lit(0))
    return both.withColumn("verdict", verdict(F.avg("news").over(w), F.avg("other").over(w)))


def session_timeline(messages: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """messages: created_at, text. bucket, positive, negative, neutral, score (mean)."""
    hits = with_tweet_hits(messages.select(F.to_date("created_at").alias("bucket"), "text"), lexicon=lexicon)
    rows = hits.select("bucket", tweet_class(F.col("pos"), F.col("neg")).alias("c"), tweet_score(F.col("pos"), F.col("neg")).alias("s"))
    return rows.groupBy("bucket").agg(*[F.count_if(F.col("c") == k).alias(k) for k in ("positive", "negative", "neutral")], F.round(F.avg("s"), 4).alias("score"))


def session_terms(messages: DataFrame, stopwords: frozenset[str], limit: int = 20) -> DataFrame:
    words = messages.select(F.explode(ascii_tokens(F.col("text"))).alias("term")).filter(~F.col("term").isin(*sorted(stopwords)))
    return words.groupBy("term").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "term").limit(checked_limit(limit))


def session_authors(messages: DataFrame, author: str = "username", limit: int = 20) -> DataFrame:
    return messages.groupBy(F.col(author).alias("author")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "author").limit(checked_limit(limit))


def stored_messages(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """What is new by (session_id, tweet_id), once each."""
    return fresh.dropDuplicates(["session_id", "tweet_id"]).join(stored.select("session_id", "tweet_id"), ["session_id", "tweet_id"], "left_anti")


def search_query(keywords: list[str] | None = None, accounts: list[str] | None = None, raw: str | None = None, language: str | None = None, retweets: bool = False, replies: bool = False) -> str:
    """A boolean query string: keywords and accounts joined by OR in brackets, filters after them."""
    words = list(dict.fromkeys(k.strip() for k in keywords or () if k.strip()))
    names = list(dict.fromkeys(a.strip().lstrip("@").lower() for a in accounts or () if a.strip()))
    group = lambda xs: xs[0] if len(xs) == 1 else "(" + " OR ".join(xs) + ")"
    parts = [group([f'"{w}"' if " " in w else w for w in words])] if words else []
    parts += [group([f"from:{n}" for n in names])] if names else []
    parts += [raw.strip()] if raw and raw.strip() else []
    if not parts:
        raise ValueError("keywords, accounts or a query are needed")
    parts += [f"lang:{language}"] if language else []
    return " ".join(parts + ([] if retweets else ["-is:retweet"]) + ([] if replies else ["-is:reply"]))


def parse_lookback(said: str) -> timedelta:
    """Such as 2h30m, 7d or 1w."""
    found = re.findall(r"(\d+)([wdhms])", said.strip().lower())
    if not found or "".join(n + u for n, u in found) != said.strip().lower():
        raise ValueError(f"no duration: {said!r}")
    names = {"w": "weeks", "d": "days", "h": "hours", "m": "minutes", "s": "seconds"}
    return sum((timedelta(**{names[u]: int(n)}) for n, u in found), timedelta())
