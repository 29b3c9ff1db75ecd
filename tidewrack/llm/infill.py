"""Fill-in-the-middle transformation over relational units, with DataFrame operations only.

A text is cut into units (a word with the blanks before it, or the blanks at the end). Documents that are to be
transformed are dealt by row once; there their units are rows (posexplode) with running sums of unit lengths (a window),
the cuts asked for are joined to them by row and unit ordinal, the offsets found are aggregated per row, and the text is
cut by substrings. Everything after that one exchange is partitioned by row already, so nothing is shuffled again.
Documents that stay plain are not dealt at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.llm.common import SPACE_CLASS, shuffle_partitions, text_or_empty

#: Possessive, as no unit ever needs to give characters back; the units are those of the greedy form.
UNIT_PATTERN = rf"[{SPACE_CLASS}]*+[^{SPACE_CLASS}]++|[{SPACE_CLASS}]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Percent of documents that are transformed, and percent of those with the suffix first.
RATE, SPM_RATE = 50, 80


def _draw(k: int, seed: int) -> Column:
    """The k-th (from 1) group of eight hexadecimal digits of the id's hash, as an unsigned number; a null id is hashed as the word null."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(said, 256), 8 * k - 7, 8), 16, 10).cast("long")


def form_column(seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Column:
    """plain, psm or spm, of doc_id and text."""
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | held | (_draw(3, seed) % 100 >= rate)
    return F.when(plain, "plain").when(_draw(4, seed) % 100 < spm_rate, "spm").otherwise("psm")


def unit_count() -> Column:
    return F.regexp_count(F.col("text"), F.lit(UNIT_PATTERN)).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """docs: row, doc_id, text. (row, doc_id, ordinal, upto): each unit by its ordinal, from 1, with the code points up to its end; and ordinal 0, with none."""
    lengths = F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all("text", F.lit(UNIT_PATTERN), F.lit(0)), F.length))
    rows = docs.select("row", "doc_id", F.posexplode(lengths).alias("ordinal", "length"))
    running = Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("row", "doc_id", "ordinal", F.sum("length").over(running).alias("upto"))


def cut_requests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs: row, doc_id, text. (row, at): after how many units the text is to be cut, twice."""
    spots = docs.select("row", unit_count().alias("n"), _draw(1, seed).alias("h1"), _draw(2, seed).alias("h2"))
    return spots.select("row", F.explode(F.array(*[(F.col(h) % (F.col("n") + 1)).cast("int") for h in ("h1", "h2")])).alias("at"))


def restored_column(output: str = "output", form: str = "form") -> Column:
    """The text that an output of that form was made of. The parts hold no marks, so each mark's first place is its own."""
    said = F.col(output)

    def parts(first: str, second: str) -> list[Column]:
        """What follows each of the three marks, in the order they stand in."""
        rest = F.expr(f"substring({output}, {len(first) + 1})")
        head = F.substring_index(rest, second, 1)
        tail = F.substring(rest, F.length(head) + F.lit(len(second) + 1), F.length(rest))
        mid = F.substring_index(tail, MIDDLE, 1)
        return [head, mid, F.substring(tail, F.length(mid) + F.lit(len(MIDDLE) + 1), F.length(tail))]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(F.col(form) == "plain", said).when(F.col(form) == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def infilled(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs: doc_id, text. One row each: doc_id, n (units), form, prefix_chars, middle_chars (code points, null if plain) and output.

    A null text counts as empty and stays plain, as do empty texts and those that hold a mark; an empty table gives an
    empty one. Repeated rows and ids are transformed alike, row by row; null ids as the id "null". Other columns are
    ignored, whatever their names. A text is one row of any length; its units are rows that Spark can spill.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    form = form_column(seed, rate, spm_rate)
    plain = rows.filter(form == "plain").select("doc_id", unit_count().alias("n"), F.lit("plain").alias("form"), F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.col("text").alias("output"))
    # all three uses need the same three columns, so they share the exchange
    dealt = rows.filter(form != "plain").repartition(shuffle_partitions(spark), "row")
    requests = cut_requests(dealt, seed).withColumnRenamed("row", "cut_row")
    # the ordinals are compared as a difference, since a second key of equal columns would have both sides dealt by both keys anew
    found = units(dealt).join(requests, (F.col("row") == F.col("cut_row")) & (F.col("ordinal") - F.col("at") == 0))
    offsets = found.groupBy("row").agg(F.min("upto").alias("a"), F.max("upto").alias("b"), F.first("doc_id").alias("of"))
    cuts = dealt.join(offsets, "row").select("of", unit_count().alias("n"), form.alias("form"), "text", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    text, a, b = F.col("text"), F.col("a"), F.col("b")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = cuts.select(F.col("of").alias("doc_id"), "n", "form", a.cast("long").alias("prefix_chars"), (b - a).cast("long").alias("middle_chars"), F.when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))
    return plain.unionByName(made)


def digests(made: DataFrame) -> DataFrame:
    """The rows of infilled, with hashes of the output and of the text restored from it in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored_column()).alias("restored_sha256"))


#: The same in DuckDB's SQL; the restored text is put together from the parts.
INFILLED_SQL = rf"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS x,
         CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {RATE} THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM rows),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(x, y)], '') AS prefix, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(units[greatest(x, y) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""
