"""A sink of JSON lines in chunks: df.write.format("tidewrack_jsonl").option("path", folder).mode("append").save().

A task writes chunks under hidden names, and begins another after so many records or bytes; when all tasks are done the
driver gives the chunks their names, so readers see whole chunks of whole jobs only. What a failed task or job has left is
hidden, and is deleted by `swept` once no job runs. The same for streams: a micro-batch that runs again replaces its chunks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

CHUNK_RECORDS, CHUNK_BYTES = 5_000, 64 << 20
HIDDEN = ".writing-"


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Chunks(WriterCommitMessage):
    names: list[str]
    records: int


class _Chunked:
    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.records, self.bytes = int(options.get("records", CHUNK_RECORDS)), int(options.get("bytes", CHUNK_BYTES))

    def write(self, iterator: Iterator) -> Chunks:
        system, base = store_of(self.path)
        system.create_dir(base, recursive=True)
        names, total, held, file, size = [], 0, 0, None, 0
        for row in iterator:
            line = (json.dumps(dict(zip(self.columns, row)), ensure_ascii=False, default=str) + "\n").encode("utf-8", "replace")
            if file is not None and (held >= self.records or size + len(line) > self.bytes):
                file.close()
                file = None
            if file is None:
                names.append(f"{HIDDEN}{uuid.uuid4().hex}.jsonl")
                file, held, size = system.open_output_stream(f"{base}/{names[-1]}"), 0, 0
            file.write(line)
            held, size, total = held + 1, size + len(line), total + 1
        if file is not None:
            file.close()
        return Chunks(names, total)

    def publish(self, messages: list[Chunks | None], name: str) -> None:
        system, base = store_of(self.path)
        for k, chunk in enumerate(c for m in messages if m for c in m.names):
            system.move(f"{base}/{chunk}", f"{base}/{name}-{k:06}.jsonl")

    def discard(self, messages: list[Chunks | None]) -> None:
        system, base = store_of(self.path)
        for chunk in (c for m in messages if m for c in m.names):
            system.delete_file(f"{base}/{chunk}")


class JsonlWriter(_Chunked, DataSourceWriter):
    def __init__(self, options, columns: list[str], overwrite: bool):
        super().__init__(options, columns)
        self.overwrite = overwrite

    def commit(self, messages: list[Chunks | None]) -> None:
        old = []
        if self.overwrite:
            from pyarrow import fs

            system, base = store_of(self.path)
            old = [x.path for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.is_file and x.path.endswith(".jsonl") and HIDDEN not in x.path]
        self.publish(messages, f"chunk-{uuid.uuid4().hex[:12]}")
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[Chunks | None]) -> None:
        self.discard(messages)


class JsonlStreamWriter(_Chunked, DataSourceStreamWriter):
    def commit(self, messages: list[Chunks | None], batchId: int) -> None:
        from pyarrow import fs

        system, base = store_of(self.path)
        name = f"batch-{batchId:010}"
        for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):  # of a run that was broken off
            if x.is_file and x.base_name.startswith(name + "-"):
                system.delete_file(x.path)
        self.publish(messages, name)

    def abort(self, messages: list[Chunks | None], batchId: int) -> None:
        self.discard(messages)


class JsonlSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewrack_jsonl"

    def writer(self, schema, overwrite: bool) -> JsonlWriter:
        return JsonlWriter(self.options, schema.names, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> JsonlStreamWriter:
        return JsonlStreamWriter(self.options, schema.names)


def swept(path: str) -> int:
    """Deletes what broken-off jobs have left, and says how many files that were. For when no job writes there."""
    from pyarrow import fs

    system, base = store_of(path)
    left = [x.path for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.is_file and x.base_name.startswith(HIDDEN)]
    for file in left:
        system.delete_file(file)
    return len(left)
