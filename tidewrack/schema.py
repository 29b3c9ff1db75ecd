"""The captures table: one flat row for each sighting of a document."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS_BEFORE = "doc_id capture_id parent_doc_or_dup_group source_type source_name source_locator source_shard source_offset_or_record_id discovery_channel job_id batch_id ingest_version url canonical_url domain".split()
_TIMES = "fetch_ts observed_ts published_ts last_modified".split()
REQUIRED = frozenset("doc_id capture_id source_type source_name discovery_channel ingest_version fetch_ts observed_ts text content_hash robots_decision".split())


def _fields() -> list[T.StructField]:
    named: list[tuple[str, T.DataType]] = [(n, T.StringType()) for n in _STRINGS_BEFORE] + [(n, T.TimestampType()) for n in _TIMES]
    named += [("content_type", T.StringType()), ("http_status", T.IntegerType())]
    named += [(n, T.StringType()) for n in "etag title text language content_hash".split()]
    named += [("near_dup_hash", T.LongType()), ("robots_decision", T.StringType()), ("terms_note_if_relevant", T.StringType())]
    return [T.StructField(n, t, True) for n, t in named]


CAPTURES = T.StructType(_fields())
#: As it is read from JSON: times and the fingerprint as text, to be cast with try_cast.
RAW_CAPTURES = T.StructType([T.StructField(f.name, T.StringType() if f.name in _TIMES or f.name in ("near_dup_hash", "http_status") else f.dataType, True) for f in CAPTURES])
PARTITION_COLUMNS = ("fetch_day", "source_type")
