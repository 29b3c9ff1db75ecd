"""Source intelligence: domain ranks and profiles, replication, freshness, story origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.tokens import SOURCE_STOPWORDS, ascii_tokens, counted_tokens, matches
from tidewrack.functions.windows import checked_limit, tail
from tidewrack.operators.terms import primary_language


def with_totals(rows: DataFrame, *totals: Column) -> DataFrame:
    """rows with aggregates over all of them in every row: one row, combined before it is sent, not a window in one task."""
    return rows.crossJoin(F.broadcast(rows.agg(*totals)))


def named(df: DataFrame, blank: str = "empty") -> DataFrame:
    """Rows with a domain: not empty, or not blank."""
    value = F.col("domain") if blank == "empty" else F.trim("domain")
    return df.filter(F.col("domain").isNotNull() & (value != ""))


def grouped(df: DataFrame) -> DataFrame:
    return df.filter(F.col("parent_doc_or_dup_group").isNotNull() & (F.col("parent_doc_or_dup_group") != ""))


def multi_domain_groups(df: DataFrame, since: Column | None = None, blank: str = "empty") -> DataFrame:
    """Groups that two domains or more are in; the time bound decides on groups, not on their members."""
    part = named(grouped(df), blank)
    part = part if since is None else part.filter(F.col("observed_ts") >= since)
    least = part.groupBy("parent_doc_or_dup_group").agg(F.min("domain").alias("a"), F.max("domain").alias("b"))
    return least.filter("a <> b").select("parent_doc_or_dup_group")


def origins(df: DataFrame, since: Column | None = None, blank: str = "empty") -> DataFrame:
    """A row for each group and domain: first_ts, url, and the group's origin (the earliest domain, ties by name) with origin_ts and origin_url."""
    groups = multi_domain_groups(df, since, blank)
    members = named(df, blank).join(groups, "parent_doc_or_dup_group", "left_semi").groupBy("parent_doc_or_dup_group", "domain").agg(F.min("observed_ts").alias("first_ts"), F.min_by("url", F.struct(F.col("observed_ts").isNull(), "observed_ts", "capture_id")).alias("url"))
    first = members.groupBy("parent_doc_or_dup_group").agg(F.min(F.struct(F.col("first_ts").isNull().alias("missing"), "first_ts", "domain", "url")).alias("o"))
    return members.join(first, "parent_doc_or_dup_group").select("parent_doc_or_dup_group", "domain", "first_ts", "url", F.col("o.domain").alias("origin"), F.col("o.first_ts").alias("origin_ts"), F.col("o.url").alias("origin_url"))


def replication_edges(df: DataFrame, since: Column | None = None) -> DataFrame:
    """origin, replica, count, sample_urls (of the least group)."""
    rows = origins(df, since).filter("domain <> origin")
    edges = rows.groupBy("origin", F.col("domain").alias("replica")).agg(F.count("*").alias("count"), F.min(F.struct("parent_doc_or_dup_group", "origin_url", "url")).alias("s"))
    return edges.select("origin", "replica", "count", F.array_compact(F.array("s.origin_url", "s.url")).alias("sample_urls"))


def replication_map(df: DataFrame, since: Column | None = None, limit: int = 50) -> DataFrame:
    return replication_edges(df, since).orderBy(F.desc("count"), "origin", "replica").limit(checked_limit(limit))


def top_replicators(df: DataFrame, since: Column | None = None, limit: int = 20) -> DataFrame:
    """domain, edges: by the number of origins that are copied, not of copies."""
    return replication_edges(df, since).groupBy(F.col("replica").alias("domain")).agg(F.count("*").alias("edges")).orderBy(F.desc("edges"), "domain").limit(checked_limit(limit))


def domain_stats(df: DataFrame) -> DataFrame:
    groups = multi_domain_groups(df).withColumn("multi", F.lit(1))
    rows = named(df).join(groups, "parent_doc_or_dup_group", "left")
    return rows.groupBy("domain").agg(F.count("*").alias("captures"), F.avg(F.length("text")).alias("avg_len"), F.sum(F.coalesce("multi", F.lit(0))).alias("replicated"))


def domain_rank(df: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    """domain, score, captures, replication_ratio, avg_length, velocity: .4 volume, .3 length, .2 originality, .1 velocity of 30 days."""
    stats = domain_stats(df)
    recent = named(df).filter(F.col("observed_ts").between(as_of - F.expr("interval 30 days"), as_of)).groupBy("domain").agg((F.count("*") / 30.0).alias("v"))
    rows = stats.join(recent, "domain", "left").withColumn("velocity", F.coalesce("v", F.lit(0.0))).withColumn("avg_length", F.coalesce("avg_len", F.lit(0.0)))
    rows = with_totals(rows, F.max("captures").alias("most"), F.min("avg_length").alias("lo"), F.max("avg_length").alias("hi"), F.max("velocity").alias("fastest"))
    ratio = F.col("replicated") / F.col("captures")
    length = F.when(F.col("hi") > F.col("lo"), (F.col("avg_length") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    speed = F.when(F.col("fastest") > 0, F.col("velocity") / F.col("fastest")).otherwise(F.lit(0.0))
    score = 0.4 * F.log1p("captures") / F.log1p("most") + 0.3 * length + 0.2 * (1 - ratio) + 0.1 * speed
    rows = rows.select("domain", F.round(score, 4).alias("score"), "captures", F.round(ratio, 4).alias("replication_ratio"), F.round("avg_length", 1).alias("avg_length"), F.round("velocity", 4).alias("velocity"))
    return rows.orderBy(F.desc("score"), F.desc("captures"), "domain").limit(checked_limit(limit))


def freshness(df: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    rows = named(df).groupBy("domain").agg(F.max("observed_ts").alias("last"), F.count_if(F.col("observed_ts") >= as_of - F.expr("interval 7 days")).alias("captures_7d"), F.count_if(F.col("observed_ts") >= as_of - F.expr("interval 30 days")).alias("captures_30d"))
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    days = F.coalesce(F.greatest(F.lit(0), F.floor(seconds / 86400)), F.lit(999)).cast("int")
    return rows.orderBy(F.col("last").desc_nulls_last(), "domain").limit(checked_limit(limit)).select("domain", F.to_date("last").alias("last_seen"), days.alias("days_since_last"), "captures_7d", "captures_30d")


def domain_profile(df: DataFrame, domain: str, as_of: Column, top_terms: int = 20) -> DataFrame:
    """One row of a domain; none for a domain without captures (profile_or_fail raises instead)."""
    part = df.filter(F.col("domain") == domain)
    languages = part.groupBy(primary_language().alias("k")).agg(F.count("*").alias("n")).filter("k IS NOT NULL").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("c"), F.col("k").alias("k")))), 1, 10).alias("languages"))
    types = part.groupBy(F.col("source_type").alias("k")).agg(F.count("*").alias("n")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("c"), F.col("k").alias("k")))), 1, 20).alias("source_types"))
    terms = domain_terms(part, top_terms).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col("term").alias("k")))).alias("terms"))
    total = part.agg(F.count("*").alias("captures"), F.round(F.avg(F.length("text")), 1).alias("avg_length"), F.min("observed_ts").cast("date").alias("first_seen"), F.max("observed_ts").cast("date").alias("last_seen"), F.round(F.count_if(F.col("observed_ts").between(as_of - F.expr("interval 30 days"), as_of)) / 30.0, 4).alias("velocity")).filter("captures > 0")
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["k"], F.lit(":"), (-x["c"]).cast("string"))), ",").alias(c)
    return total.crossJoin(F.broadcast(languages)).crossJoin(F.broadcast(types)).crossJoin(F.broadcast(terms)).select(F.lit(domain).alias("domain"), "captures", "avg_length", "first_seen", "last_seen", "velocity", said("languages"), said("source_types"), said("terms"))


def profile_or_fail(df: DataFrame, domain: str, as_of: Column) -> DataFrame:
    out = domain_profile(df, domain, as_of)
    if out.isEmpty():
        raise LookupError(f"no captures of {domain}")
    return out


def domain_terms(df: DataFrame, limit: int = 20) -> DataFrame:
    """Tokens of three characters and more, not all digits, without stopwords; ties by term."""
    counts = counted_tokens(df.select(ascii_tokens(F.col("text")).alias("tokens")), 3, SOURCE_STOPWORDS).filter(~F.col("term").rlike("^[0-9]+$"))
    return counts.orderBy(F.desc("count"), "term").limit(checked_limit(limit))


def story_clusters(df: DataFrame, term: str, days: int = 30) -> DataFrame:
    """Groups of two and more matching documents, with their first document and the domains after it.

    Of each domain only its first document is gathered, so a cluster's row is as wide as its domains, not its copies.
    """
    part = named(grouped(tail(df, days, "observed_ts").filter(matches(term))), "trim")
    by_domain = part.groupBy("parent_doc_or_dup_group", "domain").agg(F.count("*").alias("n"), F.min(F.struct("observed_ts", "capture_id", "title", "url")).alias("first"))
    story = by_domain.groupBy("parent_doc_or_dup_group").agg(F.sum("n").alias("docs"), F.min(F.struct(F.col("first.observed_ts").alias("ts"), F.col("first.capture_id").alias("id"), "domain", F.col("first.title").alias("title"), F.col("first.url").alias("url"))).alias("o"), F.array_sort(F.collect_list(F.struct(F.col("first.observed_ts").alias("ts"), "domain"))).alias("all"))
    return story.filter("docs >= 2")


def story_origins(df: DataFrame, term: str, days: int = 30, limit: int = 20) -> DataFrame:
    """group, origin_domain, docs, replicas, replica_domains (by time), lead_minutes to the first replica (0 without one)."""
    s = story_clusters(df, term, days)
    others = F.filter("all", lambda x: x["domain"] != F.col("o.domain"))
    s = s.withColumn("others", others)
    lead = (F.unix_micros(F.get("others", F.lit(0))["ts"].cast("timestamp")) - F.unix_micros(F.col("o.ts").cast("timestamp"))) / 60e6
    return s.select(F.col("parent_doc_or_dup_group").alias("dup_group"), F.col("o.domain").alias("origin_domain"), "docs", F.size("others").cast("long").alias("replicas"), F.array_join(F.transform("others", lambda x: x["domain"]), ",").alias("replica_domains"), F.round(F.coalesce(lead, F.lit(0.0)), 2).alias("lead_minutes")).orderBy(F.desc("replicas"), F.desc("docs"), "dup_group").limit(checked_limit(limit))


def publisher_firsts(df: DataFrame, term: str, days: int = 30, limit: int = 20) -> DataFrame:
    """domain, firsts, participated: how often a domain was first among the clusters it is in."""
    s = story_clusters(df, term, days)
    rows = s.select(F.col("o.domain").alias("origin"), F.explode("all").alias("m")).select("origin", F.col("m.domain").alias("domain"))
    out = rows.groupBy("domain").agg(F.count_if(F.col("domain") == F.col("origin")).alias("firsts"), F.count("*").alias("participated"))
    return out.filter("firsts > 0").orderBy(F.desc("firsts"), F.desc("participated"), "domain").limit(checked_limit(limit))
