"""Briefings, saved searches, webhook payloads, simulated sessions and lookups: compositions of other operators."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.functions.lexicon import DEFAULT, Lexicon
from tidewrack.operators import dedup, digest, quality, sentiment, terms
from tidewrack.operators.search import SearchResult, search


def movers(df: DataFrame, top: list[str], days: int = 14, threshold: float = 2.5, min_absolute: int = 3) -> DataFrame:
    """term, bucket, count, zscore of spikes of several terms, from one scan, strongest first."""
    series = terms.terms_frequency(df, top, days)
    w = Window.partitionBy("term")
    scored = series.withColumn("std", F.stddev_samp("count").over(w)).withColumn("mean", F.avg("count").over(w)).withColumn("n", F.count("*").over(w)).filter("n >= 3 AND std > 0")
    z = (F.col("count") - F.col("mean")) / F.col("std")
    return scored.filter((z >= threshold) & (F.col("count") >= min_absolute)).select("term", "bucket", "count", F.round(z, 4).alias("zscore")).orderBy(F.desc("zscore"), "term", "bucket")


def sentiment_shift(df: DataFrame, term: str, days: int = 14, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """last, before (mean of earlier days that have documents), shift: up, down or flat by more than .05."""
    s = sentiment.sentiment_series(df, term, days, lexicon=lexicon).filter("docs > 0")
    last = F.max("bucket").over(Window.partitionBy(F.lit(0)))
    one = s.withColumn("is_last", F.col("bucket") == last).agg(F.max(F.when(F.col("is_last"), F.col("avg_score"))).alias("last"), F.round(F.avg(F.when(~F.col("is_last"), F.col("avg_score"))), 4).alias("before"))
    d = F.col("last") - F.col("before")
    return one.withColumn("shift", F.when(d > 0.05, "up").when(d < -0.05, "down").otherwise("flat"))


def quality_trend(df: DataFrame) -> DataFrame:
    """Duplicate ratio of the last seven days against the seven before."""
    h = quality.quality_history(df, 14).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))))
    part = lambda late: F.round(F.avg(F.when((F.col("k") <= 7) == late, F.col("duplicate_ratio"))), 6)
    return h.agg(part(F.lit(True)).alias("last7"), part(F.lit(False)).alias("before7"))


def report(df: DataFrame, as_of: Column, days: int = 7, top: int = 5) -> str:
    """A page of the digest and the quality of a window; only small results reach the driver."""
    metrics = digest.digest_metrics(df, as_of, days).first().asDict() | quality.quality_snapshot(df).first().asDict()
    sections = {"terms": digest.digest_terms(df, as_of, days, top), "bigrams": digest.title_bigrams(df, as_of, days, top), "domains": terms.domain_breakdown(digest.in_window(df, as_of, days), top)}
    return digest.render_markdown("Report", metrics, {k: [tuple(r) for r in v.collect()] for k, v in sections.items()})


def detail(df: DataFrame, capture_id: str) -> DataFrame:
    """One capture with the number of its siblings."""
    one = df.filter(F.col("capture_id") == capture_id).limit(1)
    group = one.select(F.col("parent_doc_or_dup_group").alias("g"))
    n = df.join(F.broadcast(group), F.col("parent_doc_or_dup_group") == F.col("g")).agg((F.greatest(F.count("*"), F.lit(1)) - 1).alias("related_count"))
    return one.crossJoin(F.broadcast(n))  # one row each


def health(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("captures"), F.max("fetch_ts").alias("newest"), F.count_if(F.col("text").isNull()).alias("without_text"))


def dedup_check(df: DataFrame, text: str, threshold: int = dedup.THRESHOLD) -> DataFrame:
    """Captures whose text is the same or near: capture_id, distance (0 for equal content)."""
    one = df.sparkSession.createDataFrame([("?", text)], "capture_id string, text string")
    sig = dedup.signatures(one, key="capture_id").select(F.col("hi").alias("qh"), F.col("lo").alias("ql"))
    all_sigs = dedup.signatures(df.select("capture_id", "text"), key="capture_id")
    return all_sigs.join(F.broadcast(sig)).select("capture_id", dedup.hamming("hi", "lo", "qh", "ql").alias("distance")).filter(F.col("distance") <= threshold)


def run_saved(df: DataFrame, saved: DataFrame, name: str, **options) -> SearchResult:
    """saved: name, query, mode. Runs the search of that name."""
    row = saved.filter(F.col("name") == name).first()
    if row is None:
        raise LookupError(f"no saved search {name!r}")
    return search(df, row["query"], row["mode"] or "auto", **options)


def webhook_payload(firing: dict, slack: bool = False) -> dict:
    """What is posted about a firing: the firing itself, or a message."""
    if not slack:
        return firing
    return {"text": f"Alert {firing['rule_id']}: {firing['count']} documents match '{firing['term']}' (at least {firing['required']:g})"}


def delivering(post: Callable[[dict], None], slack: bool = False) -> Callable[[DataFrame, int], None]:
    """A batch function that hands each firing of a (small) batch to post, for foreachBatch."""

    def work(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            post(webhook_payload(row.asDict(), slack))

    return work


def simulated_messages(spark: SparkSession, session: str, n: int = 20, seed: int = 0, start: datetime = datetime(2024, 1, 1)) -> DataFrame:
    """n made-up messages of a session (200 at most), the same for the same seed."""
    said = F.array(*[F.lit(x) for x in ("markets rally on strong earnings", "not good news for the bank", "a very risky bubble", "nothing to report today")])
    k = F.col("id")
    pick = F.pmod(F.xxhash64(F.lit(seed), k), F.lit(4)).cast("int")
    return spark.range(max(1, min(n, 200))).select(F.lit(session).alias("session_id"), F.concat(F.lit(f"{session}-{seed}-"), k.cast("string")).alias("tweet_id"), F.concat(F.lit("user"), F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(5)).cast("string")).alias("username"), F.get(said, pick).alias("text"), F.timestamp_add("MINUTE", (k * 37).cast("int"), F.lit(start).cast("timestamp_ntz")).alias("created_at"))
