"""The Python data sources by kind: spark.read.format("tidewrack_warc").load(folder), and so on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewrack.sources.archives import WarcDataSource
from tidewrack.sources.jsonl_sink import JsonlSink

#: Sources and sinks by kind; register() makes them known to a session.
REGISTRY = {"warc": WarcDataSource, "jsonl": JsonlSink}


def register(spark: SparkSession) -> None:
    for source in REGISTRY.values():
        spark.dataSource.register(source)
