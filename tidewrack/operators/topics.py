"""Topic lifecycles, emerging terms, dominance and source impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.lexicon import DEFAULT, Lexicon
from tidewrack.functions.tokens import ANALYTICS_STOPWORDS, ascii_tokens, is_kept, matches
from tidewrack.functions.windows import checked_limit, newest, tail
from tidewrack.operators.sentiment import scored
from tidewrack.operators.sources import named, origins, replication_edges, with_totals
from tidewrack.operators.terms import terms_frequency

EMERGING_DAYS = 3
FLOOR = 3


def phase(total: Column, first_seen: Column, today: Column, now: Column, yesterday: Column, last7: Column, peak: Column, slope: Column, mean7: Column, mean14: Column, active: Column) -> Column:
    """The first rung that holds: peaking, expanding, emerging, declining, dormant, stable."""
    return (
        F.when(total == 0, "DORMANT")
        .when((now >= 1.5 * mean14) & (now < yesterday), "PEAKING")
        .when((slope > 0) & (now > mean7) & (active >= 2), "EXPANDING")
        .when((first_seen >= F.date_sub(today, EMERGING_DAYS - 1)) & (total >= FLOOR), "EMERGING")
        .when((slope < 0) | ((last7 == 0) & (peak >= FLOOR)), "DECLINING")
        .when(last7 < FLOOR, "DORMANT")
        .otherwise("STABLE")
    )


def lifecycles(df: DataFrame, terms: list[str], days: int = 30) -> DataFrame:
    """A row for each of up to ten terms, from one scan: phase, slope_7d, peak_count, peak_date, first_seen, last_seen, total."""
    if not 1 <= len(terms) <= 10:
        raise ValueError("1 to 10 terms")
    order = Window.partitionBy("term").orderBy("bucket")
    whole = Window.partitionBy("term")
    s = terms_frequency(df, terms, days).withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    back = F.col("n") - F.col("k")
    flat = lambda m: F.when(back < m, F.col("count"))
    s = s.groupBy("term").agg(
        F.sum("count").alias("total"),
        F.max("n").alias("n"),
        F.max("bucket").alias("today"),
        F.max(F.when(back == 0, F.col("count"))).alias("now"),
        F.coalesce(F.max(F.when(back == 1, F.col("count"))), F.lit(0)).alias("yesterday"),
        F.sum(flat(7)).alias("last7"),
        F.max("count").alias("peak_count"),
        F.min(F.struct((-F.col("count")).alias("c"), "bucket")).alias("peak"),
        F.coalesce(F.regr_slope(flat(7).cast("double"), F.when(back < 7, F.col("k").cast("double"))), F.lit(0.0)).alias("slope"),
        F.avg(flat(7)).alias("mean7"),
        F.avg(flat(14)).alias("mean14"),
        F.avg("count").alias("mean"),
        F.count_if(F.col("count") > 0).alias("active"),
        F.min(F.when(F.col("count") > 0, F.col("bucket"))).alias("first_seen"),
        F.max(F.when(F.col("count") > 0, F.col("bucket"))).alias("last_seen"),
    )
    slope = F.when(F.col("n") >= 7, F.col("slope")).otherwise(F.lit(0.0))
    mean7 = F.when(F.col("n") >= 7, F.col("mean7")).otherwise(F.lit(0.0))
    mean14 = F.when(F.col("n") >= 14, F.col("mean14")).otherwise(F.col("mean"))
    said = phase(F.col("total"), F.col("first_seen"), F.col("today"), F.col("now"), F.col("yesterday"), F.col("last7"), F.col("peak_count"), slope, mean7, mean14, F.col("active"))
    return s.select("term", said.alias("phase"), F.round(slope, 4).alias("slope_7d"), "peak_count", F.when(F.col("total") > 0, F.col("peak.bucket")).alias("peak_date"), "first_seen", "last_seen", "total")


def emerging(df: DataFrame, days: int = 7, limit: int = 20) -> DataFrame:
    """term, count, first_seen, domains_covered: tokens first seen in the window's last three days, three times or more."""
    end = newest(df)
    part = tail(df, days, end=end)
    rows = part.select(F.to_date("fetch_ts").alias("day"), "domain", F.explode(ascii_tokens(F.col("text"))).alias("term"))
    # counted by domain first, so the distinct count is over few rows
    small = rows.groupBy("term", "domain").agg(F.count("*").alias("n"), F.min("day").alias("day")).filter(is_kept(F.col("term"), 2, ANALYTICS_STOPWORDS))
    found = small.groupBy("term").agg(F.sum("n").alias("count"), F.min("day").alias("first_seen"), F.count(F.when(F.col("domain") != "", True)).alias("domains_covered"))
    found = found.filter((F.col("count") >= FLOOR) & (F.col("first_seen") >= F.date_sub(F.to_date(end), EMERGING_DAYS - 1)))
    return found.select("term", "count", "first_seen", "domains_covered").orderBy(F.desc("count"), "term").limit(checked_limit(limit))


def dominance(df: DataFrame, term: str, days: int = 14, limit: int = 10, lexicon: Lexicon = DEFAULT, chars: int | None = None) -> DataFrame:
    """domain, doc_count, doc_fraction, avg_sentiment of the documents with the term; of whole texts, unless chars is given."""
    hits = tail(df, days).filter(matches(term)).select(F.trim("domain").alias("domain"), (F.col("text") if chars is None else F.substring("text", 1, chars)).alias("text")).filter("domain <> ''")
    rows = scored(hits, lexicon=lexicon).groupBy("domain").agg(F.count("*").alias("doc_count"), F.avg(F.round(F.col("score") * 10_000).cast("long")).alias("s"))  # whole numbers, so the mean does not depend on their order
    rows = with_totals(rows, F.sum("doc_count").alias("all"))
    return rows.select("domain", "doc_count", F.round(F.col("doc_count") / F.col("all"), 4).alias("doc_fraction"), (F.round("s") / 10_000).alias("avg_sentiment")).orderBy(F.desc("doc_count"), "domain").limit(checked_limit(limit))


def lead_times(df: DataFrame, since: Column | None = None) -> DataFrame:
    """origin, replica_edges, avg_lead_minutes over groups of two and more domains."""
    members = origins(df, since, blank="trim")
    replicas = members.filter("domain <> origin")
    lead = (F.unix_micros(F.col("first_ts").cast("timestamp")) - F.unix_micros(F.col("origin_ts").cast("timestamp"))) / 60e6
    return replicas.groupBy("origin").agg(F.count("*").alias("replica_edges"), F.avg(lead).alias("avg_lead_minutes"))


def source_impact(df: DataFrame, since: Column | None = None, limit: int = 20) -> DataFrame:
    """domain, impact_score, captures, replica_edges, avg_lead_minutes. Copies weigh by the logarithm of the number of relations."""
    edges = replication_edges(df, since).groupBy("origin").agg(F.sum("count").alias("copies"), F.count("*").alias("degree"))
    part = named(df) if since is None else named(df).filter(F.col("observed_ts") >= since)
    own = with_totals(part.groupBy("domain").agg(F.count("*").alias("captures")), F.max("captures").alias("most"))
    lead = lead_times(df, since).select("origin", "avg_lead_minutes")
    rows = edges.join(own, edges["origin"] == own["domain"], "left").drop("domain").join(lead, "origin", "left")
    score = F.col("copies") * F.log1p("degree") + F.coalesce(F.log1p("captures") / F.log1p("most"), F.lit(0.0))
    rows = rows.select(F.col("origin").alias("domain"), F.round(score, 4).alias("impact_score"), F.coalesce("captures", F.lit(0)).alias("captures"), F.col("degree").alias("replica_edges"), F.round(F.coalesce("avg_lead_minutes", F.lit(0.0)), 2).alias("avg_lead_minutes"))
    return rows.orderBy(F.desc("impact_score"), F.desc("captures"), "domain").limit(checked_limit(limit))
