"""Digests, reports and exports of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.tokens import DIGEST_STOPWORDS, counted_tokens, is_kept, letter_tokens
from tidewrack.functions.windows import checked_limit
from tidewrack.operators.catalog import fold_key, folded
from tidewrack.operators.sources import named


def capture_time() -> Column:
    return F.coalesce("observed_ts", "fetch_ts")


def in_window(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    return df.filter(capture_time().between(as_of - F.expr(f"interval {days} days"), as_of))


def digest_metrics(df: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row: captures, previous (the window before, its end left out), growth, domains, new_domains."""
    start = as_of - F.expr(f"interval {days} days")
    before = as_of - F.expr(f"interval {2 * days} days")
    t = capture_time()
    now, then = t.between(start, as_of), (t >= before) & (t < start)
    main = df.agg(F.count_if(now).alias("captures"), F.count_if(then).alias("previous"), F.count_distinct(F.when(now & (F.trim("domain") != ""), F.col("domain"))).alias("domains"))
    new = new_domains(df, as_of, days).agg(F.count("*").alias("new_domains"))
    growth = F.round((F.col("captures") - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0)), 4)
    return main.crossJoin(F.broadcast(new)).select("captures", "previous", growth.alias("growth"), "domains", "new_domains")  # single rows


def new_domains(df: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    first = named(df, "trim").groupBy("domain").agg(F.min(capture_time()).alias("first_ts"))
    return first.filter(F.col("first_ts").between(as_of - F.expr(f"interval {days} days"), as_of))


def digest_terms(df: DataFrame, as_of: Column, days: int = 7, limit: int = 20, chars: int | None = None) -> DataFrame:
    """Letters-only tokens of three and more of title and text (whole texts, unless chars is given)."""
    part = in_window(df, as_of, days).select(F.concat_ws(" ", "title", F.col("text") if chars is None else F.substring("text", 1, chars)).alias("t"))
    rows = counted_tokens(part.select(letter_tokens(F.col("t")).alias("tokens")), 3, DIGEST_STOPWORDS)
    return rows.orderBy(F.desc("count"), "term").limit(checked_limit(limit))


def title_bigrams(df: DataFrame, as_of: Column, days: int = 7, limit: int = 20) -> DataFrame:
    part = in_window(df, as_of, days).select(F.filter(letter_tokens(F.col("title")), lambda t: is_kept(t, 3, DIGEST_STOPWORDS)).alias("w")).filter(F.size("w") > 1)
    pairs = F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return part.select(pairs.alias("term")).groupBy("term").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "term").limit(checked_limit(limit))


def render_markdown(title: str, metrics: dict, sections: dict[str, list[tuple]]) -> str:
    """Driver-side: small results as a page."""
    lines = [f"# {title}", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in metrics.items()]]
    for name, rows in sections.items():
        lines += ["", f"## {name}", "", *([f"- {r[0]}: {r[1]}" for r in rows] or ["- none"])]
    return "\n".join(lines) + "\n"


# ---- exports ---------------------------------------------------------------------------------------------------------


def llm_records(df: DataFrame, dedupe: bool = True, domains: list[str] | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """instruction and input (null), output (title, empty line, text) and metadata; folded to the earliest of each group."""
    t = capture_time()
    df = df if start is None else df.filter(t >= start)
    df = df if end is None else df.filter(t <= end)
    df = df.filter(F.lower("domain").isin([d.lower() for d in domains])) if domains else df
    df = folded(df, "group", newest=False, time=t) if dedupe else df
    output = F.regexp_replace(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit(""))), r"^\n+|\n+$", "")
    meta = F.struct("capture_id", "doc_id", "url", "domain", "source_type", "language", F.col("fetch_ts").cast("string").alias("fetch_ts"), F.col("observed_ts").cast("string").alias("observed_ts"))
    return df.select(F.lit(None).cast("string").alias("instruction"), F.lit(None).cast("string").alias("input"), output.alias("output"), meta.alias("metadata"))


def write_llm(df: DataFrame, path: str, fmt: str = "jsonl", limit: int | None = None, **options) -> None:
    rows = llm_records(df, **options)
    rows = rows if limit is None else rows.limit(max(1, min(limit, 100_000)))
    if fmt == "jsonl":
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        rows.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("fmt is jsonl or parquet")


def exported(df: DataFrame, unique: str = "none", domain: str = "", source: str = "", limit: int | None = 1000) -> DataFrame:
    """Rows newest first, as many as limit says; None gives all."""
    df = df.filter(F.lower("domain") == domain.lower()) if domain else df
    df = df.filter(F.lower("source_type") == source.lower()) if source else df
    rows = folded(df, unique).orderBy(F.col("fetch_ts").desc_nulls_last(), "capture_id")
    return rows if limit is None else rows.limit(max(1, limit))


def write_texts(df: DataFrame, path: str) -> None:
    """One text row a document, as text files of many documents each."""
    df.select(F.concat_ws("\n", F.coalesce("title", F.lit("")), "text")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_captures(df: DataFrame, path: str, max_records: int = 5_000_000) -> None:
    """Appends to the day and source partitions; a commit is whole or not at all."""
    rows = df.withColumn("fetch_day", F.to_date("fetch_ts")).hint("rebalance", "fetch_day", "source_type")  # few files a partition, large ones split
    rows.write.mode("append").option("maxRecordsPerFile", max_records).partitionBy("fetch_day", "source_type").parquet(path)


def fold_of(df: DataFrame, unique: str) -> DataFrame:
    return df.select("capture_id", fold_key(unique).alias("fold"))
