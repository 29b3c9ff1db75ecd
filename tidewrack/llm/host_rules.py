"""Host-level quality rules, with DataFrame operations only.

Each text is measured inside its own row (array functions, no explosion of words). Failures of the rules are summed by
host; a host's failure rate is shrunk towards all hosts' by a beta prior fitted to the hosts by moments, so a host with
few documents is not judged by them alone; hosts whose shrunk rate is above a limit are rejected, and that verdict is
joined back to the documents: those of hosts with a large share of all rows by broadcast, as there are few such hosts,
the others by shuffle. One row a host is all that is shuffled besides the numbers of each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import SPACE_CLASS, WORD_PATTERN, cut, join_by_hot_keys, text_or_empty

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
#: Bits of a window's hash that are sorted together with its place in one long.
PACKED_BITS = 48
#: A host is rejected if its shrunk failure rate is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR_LEAST, PRIOR_MOST = 2.0, 1000.0


def _repeat_words(words: Column, grams: Column) -> Column:
    """What words inside a window of three that is found twice or more are counted from: grams has a hash of each window, in order.

    Windows are ordered by hash and place, so equal ones are neighbours: as longs of the hash's high bits and the place where
    those leave PACKED_BITS for the hash, which sorts fast, and as pairs in longer texts.
    """
    n = F.size(grams)
    low = F.lit((1 << (64 - PACKED_BITS)) - 1)
    packed = F.sort_array(F.transform(grams, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
    fast = F.transform(packed, lambda x: x.bitwiseAND(low).cast("int"))
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    order = F.when(n <= 1 << (64 - PACKED_BITS), fast).otherwise(F.transform(pairs, lambda x: x["i"]))
    return F.struct(grams.alias("g"), order.alias("at"), n.alias("n"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and the numbers of each row of docs."""
    text = text_or_empty("text")
    df = docs.select("doc_id", "source", text.alias("t"))
    df = df.select("doc_id", "source", "t", F.array_remove(F.split("t", f"[{SPACE_CLASS}]+"), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"))
    grams = F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    df = df.select(
        "doc_id",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("g"),
    )
    twice = F.size(F.array_distinct("g")) < F.size("g")
    df = df.withColumn("r", F.when(F.col("g").isNotNull() & twice, _repeat_words(F.col("n_words"), F.col("g"))))

    def place(k: Column) -> Column:
        return F.get("r.at", k)

    def gram(k: Column) -> Column:
        return F.get("r.g", place(k))

    same = F.transform(F.sequence(F.lit(1), F.col("r.n") - 1), lambda k: gram(k) == gram(k - 1))
    df = df.withColumn("same", F.when(F.col("r").isNotNull(), same))
    found = F.transform(F.sequence(F.lit(0), F.col("r.n") - 1), lambda k: F.when(F.coalesce(F.get("same", k - 1), F.lit(False)) | F.coalesce(F.get("same", k), F.lit(False)), place(k)).otherwise(F.lit(-1)))
    df = df.withColumn("at", F.when(F.col("r").isNotNull(), F.sort_array(F.filter(found, lambda p: p >= 0))))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda a, p: F.struct((a["n"] + F.lit(3) - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    failed = base | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
    return df.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), failed.alias("failed"))


def host_verdicts(hosts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """hosts: host, n, f (documents and failures), a row a host. Adds rate (shrunk) and good."""
    one = hosts.agg(F.sum("n").alias("all_n"), F.sum("f").alias("all_f"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("squares"))
    mean = F.col("all_f") / F.col("all_n")
    one = one.select(mean.alias("mean"), (F.col("squares") / F.col("all_n") - mean * mean).alias("var"))
    strength = F.when(F.col("var") <= 1e-9, F.lit(PRIOR_MOST)).otherwise(F.greatest(F.lit(PRIOR_LEAST), F.least(F.lit(PRIOR_MOST), F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1)))
    one = one.select("mean", strength.alias("strength"))
    rate = (F.col("f") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(one)).select("host", "n", "f", rate.alias("rate"), (rate <= limit).alias("good"))


def host_filtered(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """docs: doc_id, source (the host), text. One row each: the numbers, base_failed, kept, host_docs, host_failed.

    A null text has no words, a null source is a host of its own, repeated rows count each time; other columns are ignored.
    """
    rows = cut(measured(docs).withColumn("host", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    out = join_by_hot_keys(rows, cut(host_verdicts(hosts, limit)), "host")
    kept = ~F.col("base_failed") & F.col("good")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("n").alias("host_docs"), F.col("f").alias("host_failed"))


#: The same in DuckDB's SQL.
HOST_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs) WHERE len(w) > 0),
grams AS (
  SELECT doc_id, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
found AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams WHERE g IS NOT NULL),
repeats AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, p + k AS q FROM found CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE c > 1) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g'))) AS n_symbols FROM words GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, host, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(coalesce(n_symbols, 0) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs d LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
failing AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS failed FROM judged),
hosts AS (SELECT host, count(*) AS n, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS f FROM failing GROUP BY host),
moments AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS var FROM hosts),
prior AS (SELECT mean, CASE WHEN var <= 1e-9 THEN 1000.0 ELSE greatest(2.0, least(1000.0, mean * (1 - mean) / var - 1)) END AS strength FROM moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (f + mean * strength) / (n + strength) <= 0.5 AS kept, n AS host_docs, f AS host_failed
FROM failing JOIN hosts USING (host) CROSS JOIN prior
"""
