"""Structured Streaming forms: seen-address gates, windows with watermarks, incremental loading and alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewrack.operators.catalog import upserted
from tidewrack.session import shared_subdir


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def timed(stream: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A watermark needs a timestamp with time zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def first_seen(stream: DataFrame, key: str, column: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each key once; state is kept for as long as the watermark says."""
    return timed(stream, column, delay).dropDuplicatesWithinWatermark([key])


def distinct_keys(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.dropDuplicates(list(keys))


def tumbling(stream: DataFrame, every: str = "1 hour", column: str = "ts", *by: str) -> DataFrame:
    return _counted(timed(stream, column), F.window(column, every), *by)


def sliding(stream: DataFrame, length: str = "2 hours", every: str = "1 hour", column: str = "ts", *by: str) -> DataFrame:
    return _counted(timed(stream, column), F.window(column, length, every), *by)


def sessions(stream: DataFrame, key: str = "user_id", gap: str = "30 minutes", column: str = "ts") -> DataFrame:
    rows = timed(stream, column).groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count("*").alias("count"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def _counted(stream: DataFrame, window: Column, *by: str) -> DataFrame:
    return stream.groupBy(window.alias("w"), *by).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "count")


def drained(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared folder, and returns that. Batches that run again replace what they wrote."""
    spark = stream.sparkSession
    folder = shared_subdir(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/batch=-1")  # for a stream without batches

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number if mode == 'append' else 0}")

    each_batch(stream, keep, checkpoint or shared_subdir(spark, f"{name}-offsets"), mode=mode).awaitTermination()
    return spark.read.parquet(folder).select(*stream.columns)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Calls work on every micro-batch: of all that is there now, or every so often."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def loading_into(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that appends the captures a Parquet table has not yet; a batch that runs again adds nothing."""

    def work(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["capture_id"])
        try:
            fresh = upserted(spark.read.parquet(path), fresh)
        except Exception as error:  # nothing is there before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh.write.mode("append").parquet(path)

    return work


def near_dup_stage(store: str, decide: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch function that decides on the batch together with what is stored, and appends the batch's captures with their decisions."""

    def work(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(store).select(*batch.columns)
            both = known.unionByName(upserted(known, batch))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known, both = batch.limit(0), batch
        upserted(known, batch).join(decide(both), "capture_id").write.mode("append").parquet(store)

    return work
