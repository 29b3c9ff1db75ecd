"""Mixing sources to target weights, with DataFrame operations only.

Documents get a hash-random key. Within each source they are ordered by that key over range buckets: sums by bucket
are made first (combined before the shuffle), running sums over the bucket sums, and over groups of buckets, give each
bucket its offset, and a running sum inside the bucket gives each document its place. A source is cut into as many
buckets as its rows need, and the order does not depend on their number. The budget of a source is cut exactly: whole
epochs, then a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import WORD_PATTERN, as_struct, cut, shared_subdir, shuffle_partitions

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Mean rows that a range bucket of the largest source holds at most.
BUCKET_ROWS = 1_024


def word_count(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _placed(sizes: DataFrame) -> DataFrame:
    """Adds place: the number, from 0, of each source in code-point order, null last. Sources are cut into ranges; only a row a range is summed in one task."""
    order = F.col("source").asc_nulls_last()
    ranged = cut(sizes.repartitionByRange(shuffle_partitions(sizes.sparkSession), order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range").agg(F.count("*").alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(counts), "range").select("source", "source_size", (F.col("inside") + F.col("before")).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), a row a source. Adds target: shares of the total by weight, none above `most` times its size.

    Sources in code-point order, null last, weigh as weights repeat. Sources whose share reaches their limit stop there, and
    what is left is shared by weight again until none is above; each time takes two sums over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows = cut(_placed(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    total, all_weight = [x or 0 for x in rows.agg(F.sum("source_size"), F.sum("weight")).first()]
    words, share = total, all_weight

    def full() -> Column:
        return F.col("cap") * F.lit(share) <= F.lit(words) * F.col("weight")

    while share:
        capped, spent = [x or 0 for x in rows.filter(full()).agg(F.sum("cap"), F.sum("weight")).first()]
        if (total - capped, all_weight - spent) == (words, share):
            break
        words, share = total - capped, all_weight - spent
    target = F.when(full(), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(words) / F.lit(share)) if share else F.col("cap").cast("double")
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _mixed(docs: DataFrame, carried: tuple[str, ...], weights: tuple[int, ...], most: int, seed: str, bucket_rows: int) -> DataFrame:
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.xxhash64("text").cast("string")))
    key = F.md5(F.concat(F.lit(seed + ":"), named).cast("binary"))
    sized = cut(docs.select(*carried, "doc_id", "source", word_count("text").alias("size"), key.alias("key"), F.xxhash64("text").alias("tie")))
    by_source = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key")
    targets = source_targets(by_source.select("source", "source_size"), weights, most).select(name, "source_size", "target")
    n = by_source.agg(F.max("n")).first()[0] or 0
    digits = 0
    while n / 16**digits > bucket_rows:
        digits += 1
    bucketed = sized.withColumn("source_key", name).withColumn("bucket", F.substring("key", 1, digits))
    sums = bucketed.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    # buckets are summed within groups of buckets, and groups within the source, so that neither sum is long
    sums = cut(sums.withColumn("group", F.substring("bucket", 1, digits // 2)))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("source_key", "group").agg(F.sum("words").alias("words"))
    groups = groups.select("source_key", "group", F.coalesce(F.sum("words").over(earlier.partitionBy("source_key")), F.lit(0)).alias("base"))
    running = Window.partitionBy("source_key", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("within", F.coalesce(F.sum("words").over(running), F.lit(0))).join(groups, ["source_key", "group"]).join(targets, "source_key")
    offsets = offsets.select("source_key", "bucket", "source_size", "target", (F.col("base") + F.col("within")).alias("offset"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # all that a row needs comes with its bucket, so the rows are dealt by source and bucket once, never by source alone
    placed = bucketed.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["source_key", "bucket"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    start = F.col("offset") + F.col("upto") - F.col("size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    taken = (epochs * F.col("size") + partial).cast("long")
    return placed.select(*carried, "doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs: doc_id, source, text. Returns doc_id, size, source_size, target, taken for each row.

    taken counts the words that the mix takes of a document: size for each whole epoch of its source, and in the last,
    partial epoch all, some (one document a source, at the cut) or none. The sum over a source is its target, rounded.
    A null text has size 0; a null source is a source; rows with null ids have a key by their text, repeated ids are ordered
    by a hash of the text; an empty table gives an empty one. Other columns are ignored.
    """
    return _mixed(docs, (), weights, most, seed, bucket_rows)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mix itself: each row of docs as often as its taken words make whole documents, to the nearest; its columns as they are.

    Rows of size 0 are not taken. Rows are numbered once, in a table in the shared folder that both the decisions and the
    result are read from; each row is one column there, so its own columns may have any names.
    """
    spark = docs.sparkSession
    folder = shared_subdir(spark, "mixing")
    docs.select(as_struct(docs).alias("doc"), F.monotonically_increasing_id().alias("row")).write.parquet(folder)
    placed = spark.read.parquet(folder)
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    taken = _mixed(placed.select("row", "doc.doc_id", "doc.source", "doc.text"), ("row",), weights, most, seed, bucket_rows)
    taken = taken.select("row", copies.alias("copies")).filter("copies > 0")
    return placed.join(taken, "row").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")


#: The same in DuckDB's SQL.
MIXED_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
summed AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS left_words,
         CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS left_weight,
         row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS place
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, cap * left_weight <= left_words * weight AS filled FROM summed),
level AS (SELECT left_words AS level_words, left_weight AS level_weight FROM flagged WHERE NOT filled ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE weight * level_words / level_weight END AS target
  FROM flagged LEFT JOIN level ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size
         + greatest(0, least(size, budget % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
