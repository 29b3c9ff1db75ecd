"""Lexicon sentiment as array expressions, and its series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.lexicon import DEFAULT, Lexicon
from tidewrack.functions.tokens import ascii_tokens, matches
from tidewrack.functions.windows import bucket, calendar, newest, tail


def _words(words: frozenset[str]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(words)])


def scored(df: DataFrame, text: Column | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds pos, neg, score and tokens_scanned. A negation within three tokens before turns a word; intensifiers there add half each."""
    names = df.columns
    tokens = ascii_tokens(F.col("text") if text is None else text)
    df = df.withColumn("__t", tokens)
    signed = F.transform("__t", lambda t, i: F.when(F.array_contains(_words(lexicon.positive), t), F.struct(F.lit(1).alias("p"), i.alias("i"))).when(F.array_contains(_words(lexicon.negative), t), F.struct(F.lit(-1).alias("p"), i.alias("i"))))
    df = df.withColumn("__h", F.filter(signed, lambda x: x.isNotNull()))

    def weight(hit: Column) -> Column:
        size = F.least(hit["i"], F.lit(lexicon.reach))
        before = F.when(size > 0, F.slice("__t", hit["i"] - size + 1, F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        turned = F.when(F.arrays_overlap(before, _words(lexicon.negations)), -hit["p"]).otherwise(hit["p"])
        strong = F.size(F.filter(before, lambda b: b.isin(*sorted(lexicon.intensifiers))))
        return turned * (1.0 + lexicon.intensity * strong)

    df = df.withColumn("__w", F.transform("__h", weight))
    total = lambda sign: F.aggregate("__w", F.lit(0.0), lambda a, w: a + F.greatest(F.lit(0.0), sign * w))
    df = df.withColumn("pos", total(F.lit(1.0))).withColumn("neg", total(F.lit(-1.0)))
    score = F.when(F.col("pos") + F.col("neg") > 0, (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg"))).otherwise(F.lit(0.0))
    return df.select(*names, "pos", "neg", F.round(score, 4).alias("score"), F.size("__t").alias("tokens_scanned"))


def sentiment_series(df: DataFrame, term: str, days: int = 14, granularity: str = "day", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """bucket, docs, positive, negative, avg_score over the documents with the term; zeros included."""
    end = newest(df)
    hits = tail(df, days, end=end).filter(matches(term)).select("fetch_ts", "text")
    rows = scored(hits, lexicon=lexicon).groupBy(bucket(F.col("fetch_ts"), granularity).alias("bucket")).agg(F.count("*").alias("docs"), F.count_if(F.col("score") > 0).alias("positive"), F.count_if(F.col("score") < 0).alias("negative"), F.avg("score").alias("avg_score"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return calendar(df, days, granularity=granularity, end=end).join(rows, "bucket", "left").select("bucket", zero("docs"), zero("positive"), zero("negative"), F.round(F.coalesce("avg_score", F.lit(0.0)), 4).alias("avg_score"))


def market_heat(df: DataFrame, term: str, days: int = 30, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """One row: docs, positive, negative, ratio, volatility (population deviation of daily averages), slope of the last seven days."""
    from pyspark.sql import Window

    series = sentiment_series(df, term, days, lexicon=lexicon).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bucket")))
    last = F.max("k").over(Window.partitionBy(F.lit(0)))
    series = series.withColumn("recent", F.col("k") > last - 7)
    slope = F.regr_slope(F.when(F.col("recent"), F.col("avg_score")), F.when(F.col("recent"), F.col("k").cast("double")))
    return series.agg(F.sum("docs").alias("docs"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.round(F.coalesce(F.sum("positive") / F.nullif(F.sum("positive") + F.sum("negative"), F.lit(0)), F.lit(0.0)), 4).alias("positive_ratio"), F.round(F.stddev_pop("avg_score"), 4).alias("volatility"), F.round(F.coalesce(slope, F.lit(0.0)), 4).alias("slope_7d"))


def with_tweet_hits(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds whole hits, pos and neg: a negation within three tokens before turns a word, intensifiers count for nothing."""
    weighed = scored(df.withColumn("__text", F.col(text)), F.col("__text"), Lexicon(lexicon.positive, lexicon.negative, lexicon.negations, frozenset({""}), lexicon.reach, 0.0))
    return weighed.select(*df.columns, F.col("pos").cast("int").alias("pos"), F.col("neg").cast("int").alias("neg"))


def tweet_class(pos: Column, neg: Column) -> Column:
    return F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")


def tweet_score(pos: Column, neg: Column) -> Column:
    return (pos - neg) / (pos + neg + F.lit(1e-9))
