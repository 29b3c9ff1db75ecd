"""Task queues, manifests and metrics as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.session import cut


def backlog(manifests: DataFrame, as_of: Column) -> DataFrame:
    """manifests: records, bytes, created_at, compacted. One row: files, records, bytes, oldest_seconds."""
    part = manifests.filter(~F.col("compacted"))
    return part.agg(F.count("*").alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.min("created_at").cast("timestamp"))).alias("oldest_seconds"))


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("job_id", "status").agg(F.count("*").alias("count"))


def last_checkpoints(tasks: DataFrame) -> DataFrame:
    """The newest completed checkpoint of each partition."""
    return tasks.filter("status = 'completed'").groupBy("partition_key").agg(F.max_by("checkpoint", F.struct("completed_at", "task_id")).alias("checkpoint"))


def seed_progress(tasks: DataFrame, fetches: DataFrame) -> DataFrame:
    """tasks: seed, status; fetches: seed, url. Statuses and fetch numbers of each seed."""
    a = tasks.groupBy("seed").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"))
    return a.join(fetches.groupBy("seed").agg(F.count("*").alias("fetched")), "seed", "left").fillna(0, ["fetched"])


def new_tasks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Idempotent: what is not yet there by job and partition key, once each."""
    return fresh.dropDuplicates(["job_id", "partition_key"]).join(stored.select("job_id", "partition_key"), ["job_id", "partition_key"], "left_anti")


def retry_delay(attempts: Column, base: float = 30.0, most: float = 3600.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)))


def orphaned(tasks: DataFrame, as_of: Column, lease_seconds: int, max_retries: int) -> DataFrame:
    """Running tasks whose lease is over: requeue, or dead-letter beyond the retries."""
    late = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")) > lease_seconds
    return tasks.filter((F.col("status") == "running") & late).withColumn("action", F.when(F.col("attempts") >= max_retries, "dead_letter").otherwise("requeue"))


def claimed(tasks: DataFrame, n: int, as_of: Column) -> DataFrame:
    """The next n pending tasks that are due, as running: oldest first, ties by id. One writer at a time merges them into the table."""
    due = tasks.filter((F.col("status") == "pending") & (F.coalesce("next_at", as_of) <= as_of))
    return due.orderBy(F.col("created_at").asc_nulls_first(), "task_id").limit(n).withColumns({"status": F.lit("running"), "started_at": as_of, "attempts": F.col("attempts") + 1})


def rearmed(tasks: DataFrame, wanted: DataFrame, reset_attempts: bool = True) -> DataFrame:
    """Dead tasks that wanted names (task_id), as pending again."""
    rows = tasks.filter("status = 'dead'").join(wanted.select("task_id").distinct(), "task_id", "left_semi")
    return rows.withColumns({"status": F.lit("pending"), "attempts": F.lit(0).cast(tasks.schema["attempts"].dataType) if reset_attempts else F.col("attempts")})


#: Levels of blocks of 1, 2, 4, … days, which cover all dates.
_LEVELS = 23


def _blocks_of_days(first: Column, last: Column) -> Column:
    """The fewest aligned blocks that make up the days from first to last (numbers), as (level, block): two a level at most, none if first is after last."""

    def of_level(k: Column) -> Column:
        whole = lambda c: F.call_function("shiftright", c, k)
        a, b = whole(first + F.call_function("shiftleft", F.lit(1), k) - 1), whole(last + 1) - 1
        # a block is in the list if its neighbour is not inside, or their common block would be
        at = lambda c, odd: F.when((a <= b) & (c % 2 != 0 if odd else c % 2 == 0), F.struct(k.alias("level"), c.alias("block")))
        return F.array(at(a, True), at(b, False))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), of_level)), lambda x: x.isNotNull())


def _blocks_with_day(day: Column, levels: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(day, k).alias("block")) for k in levels]).cast("array<struct<level:int,block:int>>")


def planned(requests: DataFrame, partitions: DataFrame) -> DataFrame:
    """requests: job_id, source, first, last, max_tasks; partitions: source, partition_key, first, last. job_id, partition_key of each request's tasks.

    Partitions whose days meet the request's, earliest first, up to max_tasks (null: all). A request without tasks has one row
    with a null partition_key and a reason: no_partitions of its source, or outside_window.

    Periods meet where one starts inside the other, so starts are looked up by the blocks of days that periods are made of: only
    what meets is joined. A request with max_tasks takes no more than so many partitions of a block, the earliest.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    r = requests.select("job_id", "source", "max_tasks", day("first").alias("a"), day("last").alias("b"))
    p = partitions.select("source", "partition_key", "first", day("first").alias("p_a"), day("last").alias("p_b"))
    in_window, in_partition = _blocks_of_days(F.col("a"), F.col("b")), _blocks_of_days(F.col("p_a") + 1, F.col("p_b"))
    levels = lambda df, blocks: [k for (k,) in df.select(F.explode(blocks).alias("x")).select("x.level").distinct().collect()]
    window_levels, partition_levels = levels(r, in_window), levels(p, in_partition)

    def dealt(df: DataFrame, starts_inside: Column, starts_before: Column) -> DataFrame:
        """A row for each block; late: the partition does not start before the request."""
        sides = [df.withColumns({"x": F.explode(x), "late": F.lit(late)}) for x, late in ((starts_inside, True), (starts_before, False))]
        return sides[0].union(sides[1]).select(*df.columns, "late", "x.level", "x.block")

    key = ["source", "late", "level", "block"]
    wants = dealt(r, in_window, _blocks_with_day(F.col("a"), partition_levels))
    offers = dealt(p, _blocks_with_day(F.col("p_a"), window_levels), in_partition)
    met = (F.col("p_a") <= F.col("b")) & (F.col("p_b") >= F.col("a"))
    # periods that end before they start can share a block and not meet, so they are neither counted in a block nor cut off in one
    odd, odd_request = F.col("p_a") > F.col("p_b"), F.col("a") > F.col("b")
    place = F.row_number().over(Window.partitionBy(*key, odd).orderBy("first", "partition_key"))
    placed = offers.withColumn("place", F.when(odd, 1).otherwise(place))
    size = lambda n: F.floor(F.log2(n)).cast("int")
    open_ended = F.col("max_tasks").isNull() | odd_request
    most = F.greatest("max_tasks", F.lit(1))  # at least one, to tell that something met
    few = wants.filter(~open_ended).withColumn("size", F.explode(F.sequence(F.lit(0), size(most))))
    few = few.join(placed.withColumn("size", size(F.col("place"))), [*key, "size"]).filter(met & (F.col("place") <= most))
    pair = ["job_id", "max_tasks", "first", "partition_key"]
    pairs = wants.filter(open_ended).join(offers, key).filter(met).select(*pair).union(few.select(*pair))

    ranked = pairs.filter("max_tasks IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("first", "partition_key")))
    tasks = pairs.filter("max_tasks IS NULL").select("job_id", "partition_key").union(ranked.filter("place <= max_tasks").select("job_id", "partition_key"))
    found = pairs.select(F.col("job_id").alias("found")).distinct()
    none = r.join(found, F.col("job_id").eqNullSafe(F.col("found")), "left_anti").join(p.select("source", F.lit(True).alias("known")).distinct(), "source", "left")
    reason = F.when(F.every(F.col("known").isNotNull()), "outside_window").otherwise("no_partitions")
    return tasks.select("job_id", "partition_key", F.lit(None).cast("string").alias("reason")).union(none.groupBy("job_id").agg(F.lit(None).cast("string"), reason))


def subpartitioned(tasks: DataFrame, found: DataFrame) -> DataFrame:
    """found: partition_key, sub_key, as running tasks have discovered them. New pending tasks of the same jobs, each key once and not yet there."""
    rows = tasks.join(found, "partition_key").select("job_id", F.col("sub_key").alias("partition_key"))
    return new_tasks(tasks, rows).withColumn("status", F.lit("pending"))


def expired(tasks: DataFrame, as_of: Column, days: int) -> DataFrame:
    return tasks.filter(F.col("status").isin("completed", "failed") & (F.col("completed_at") < as_of - F.expr(f"interval {days} days")))


def percentile(value: str, share: float) -> Column:
    """Nearest rank: the value at share * (n - 1), rounded half to even, of the sorted values. For small groups: a group is one list; `percentiles` takes any."""
    ordered = F.array_sort(F.collect_list(value))
    return F.get(ordered, F.bround(F.lit(share) * (F.size(ordered) - 1)).cast("int"))


def percentiles(metrics: DataFrame, shares: dict[str, float], name: str = "name", value: str = "value") -> DataFrame:
    """name, and a column for each of shares: `percentile` of groups of any size, exactly. Nulls are not counted; a group of nulls only has nulls.

    Equal values are counted before they move; the counts are dealt in ranges of (name, value), so a large group is many tasks, and a value's
    rank is the sum of the parts before its own and of the values before it in its part.
    """
    counts = metrics.groupBy(F.col(name).alias("name"), F.col(value).alias("value")).agg(F.count(value).alias("n"))
    counts = cut(counts.repartitionByRange("name", "value").withColumn("part", F.spark_partition_id()))
    by_name, by_part = Window.partitionBy("name"), Window.partitionBy("name", "part")
    parts = counts.groupBy("name", "part").agg(F.sum("n").alias("size"))
    parts = parts.select(F.col("name").alias("of"), F.col("part").alias("in"), (F.sum("size").over(by_name.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(by_name).alias("total"))
    ranked = counts.withColumn("upto", F.sum("n").over(by_part.orderBy("value"))).join(parts, F.col("name").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    upto = F.col("upto") + F.col("before")
    rank = lambda share: F.bround(F.lit(share) * (F.col("total") - 1))
    picked = [F.max(F.when((rank(s) >= upto - F.col("n")) & (rank(s) < upto), F.col("value"))).alias(c) for c, s in shares.items()]
    return ranked.groupBy("name").agg(*picked).select(F.col("name").alias(name), *shares)


def approx_percentiles(value: str, *shares: float) -> Column:
    """For large groups: percentiles of a mergeable sketch, not of a list."""
    return F.percentile_approx(value, list(shares), 10_000)


def histogram(metrics: DataFrame) -> DataFrame:
    """metrics: name, value. count, sum, min, max, p50, p95 of each name; percentiles by a sketch, so a name may have any number of values."""
    return metrics.groupBy("name").agg(F.count("*").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), approx_percentiles("value", 0.5, 0.95).alias("p")).select("name", "count", "sum", "min", "max", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def prometheus(rows: list[tuple[str, dict, float]], prefix: str = "tidewrack") -> str:
    """Small collected metrics as text: (name, labels, value)."""
    out = []
    for name, labels, value in sorted(rows, key=lambda r: (r[0], sorted(r[1].items()))):
        said = ",".join(f'{k}="{str(v).replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"' for k, v in sorted(labels.items()))
        out.append(f"{prefix}_{''.join(c if c.isalnum() or c == '_' else '_' for c in name)}{{{said}}} {value:g}")
    return "\n".join(out) + "\n"


def feed_health(fetches: DataFrame) -> DataFrame:
    """fetches: feed, status, error. score = 100 - 10 a percent of errors - 5 a percent of statuses other than 200, 0 at least."""
    n = F.count("*")
    errors, others = 100 * F.count_if(F.col("error").isNotNull()) / n, 100 * F.count_if(F.coalesce(F.col("status") != 200, F.lit(True))) / n
    return fetches.groupBy("feed").agg(n.alias("fetches"), F.round(errors, 2).alias("error_percent"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 10 * errors - 5 * others)), 2).alias("score"))
