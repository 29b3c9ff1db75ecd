"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed on their own. Behind the frames of a bundle come two skippable
frames: an index that maps record identifiers to a frame and an offset inside it, and the seek table of the seekable
format (compressed and decompressed size of each frame, then their number and the magic number 0x8F92EAB1), so one
record is read by the file's tail and one frame. Any Zstandard reader that knows no seek table reads the records in order.

Each task writes bundles of its own into a folder that all executors share, under names that no other attempt uses,
and returns a row for each. The checkpointed rows are the manifest; what a lost attempt has left behind is not in it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import cut, shared_subdir, text_or_empty

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 32 * 1024 * 1024
LEVEL = 3
#: Equal payloads of so many bytes at least are written once.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    said = record.removeprefix("<urn:page:").removesuffix(">")
    return None if said == "none" else int(said)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """Headers, HTTP headers (names in lower case), payload, and where the next record begins."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start, size = head_end + 4, int(headers["content-length"])
    body = data[start : start + size]
    http_end = body.index(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in body[:http_end].decode().split("\r\n")[1:])}
    return headers, http, body[http_end + 4 :], start + size + 4


class BundleWriter:
    """Collects the frames of one bundle in memory, of bounded size."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame_bytes = frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.out: list[bytes] = []
        self.open: list[bytes] = []
        self.open_size = 0
        self.size = 0
        self.index: list[tuple[str, int, int]] = []

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.frames), self.open_size))
        self.open.append(record)
        self.open_size += len(record)
        if self.open_size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            packed = self.press.compress(b"".join(self.open))
            self.frames.append((len(packed), self.open_size))
            self.out.append(packed)
            self.size += len(packed)
            self.open, self.open_size = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        index = self.press.compress(json.dumps(self.index).encode())
        index = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        entries = [*self.frames, (len(index), 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE_MAGIC)
        return b"".join([*self.out, index, struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)), table])


class BundleReader:
    """Reads a bundle by its tail; file needs seek() and read()."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end")
        file.seek(size - 9 - 8 * count)
        entries = list(struct.iter_unpack("<II", file.read(8 * count)))
        self.offsets = [0]
        for packed, _ in entries:
            self.offsets.append(self.offsets[-1] + packed)
        self.frames = entries[:-1]
        file.seek(self.offsets[count - 1])
        raw = file.read(entries[-1][0])
        self.expand = zstandard.ZstdDecompressor()
        self.index: list[list] = json.loads(self.expand.decompress(raw[8:]))
        self.places: dict[str, tuple[int, int]] = {name: (frame, offset) for name, frame, offset in reversed(self.index)}

    def frame(self, k: int) -> bytes:
        self.file.seek(self.offsets[k])
        return self.expand.decompress(self.file.read(self.frames[k][0]), max_output_size=self.frames[k][1])

    def records(self) -> Iterator[tuple[str, dict, dict, bytes]]:
        at, data = -1, b""
        for name, frame, offset in self.index:
            if frame != at:
                at, data = frame, self.frame(frame)
            headers, http, payload, _ = parse_record(data, offset)
            yield name, headers, http, payload

    def find(self, name: str) -> tuple[dict, dict, bytes]:
        """One record by its identifier: one frame is read."""
        frame, offset = self.places[name]
        return parse_record(self.frame(frame), offset)[:3]


def open_bundle(path: str) -> BundleReader:
    system, name = fs.FileSystem.from_uri(path)
    file = system.open_input_file(name)
    return BundleReader(file, file.size())


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        system, base = fs.FileSystem.from_uri(folder)
        bundle, count, done = BundleWriter(frame_bytes), 0, []

        def close() -> None:
            data = bundle.finish()
            name = f"{base}/bundle-{attempt}-{len(done)}.warc.zst"
            with system.open_output_stream(name + ".part") as f:
                f.write(data)
            system.move(name + ".part", name)
            done.append((f"{folder}/bundle-{attempt}-{len(done)}.warc.zst", count, len(data)))

        for batch in batches:
            for page_id, url, html, first, revisit in zip(*[batch.column(k).to_pylist() for k in ("page_id", "url", "html", "first", "revisit")]):
                bundle.add(record_id(page_id), build_record(page_id, url, html.encode("utf-8", "replace"), first, revisit))
                count += 1
                if bundle.size >= bundle_bytes:
                    close()
                    bundle, count = BundleWriter(frame_bytes), 0
        if count:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return run


def write_bundles(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """pages: page_id, url, html. Writes a record for each row; returns the manifest (path, records, bytes).

    Of rows with equal payloads those with the least page_id are responses and the others revisits of it (a null id is
    a revisit if any other has an id). Repeated rows of the least id are all responses. A null html is an empty payload.
    """
    spark = pages.sparkSession
    folder = folder or shared_subdir(spark, "warc")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    repeated = rows.filter(F.octet_length("html") >= revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    rows = rows.join(repeated, "sha", "left")
    revisit = F.col("first").isNotNull() & F.coalesce(F.col("page_id") > F.col("first"), F.lit(True))
    rows = rows.select("page_id", "url", "html", "first", revisit.alias("revisit"))
    return cut(rows.mapInArrow(_writer(folder, frame_bytes, bundle_bytes), "path string, records long, bytes long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            out = []
            for name, headers, http, payload in open_bundle(path).records():
                said = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response":
                    size, digest, refers = len(payload), payload_digest(payload), None
                    if digest != said:
                        raise ValueError(f"payload of {name} in {path} does not match its digest")
                else:
                    size, digest, refers = int(http["content-length"]), said, page_of(headers["warc-refers-to"])
                out.append((page_of(name), size, digest, headers["warc-type"], refers))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)


def read_bundles(manifest: DataFrame) -> DataFrame:
    """A row for each record of the manifest's bundles: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads are held against their digests."""
    return manifest.select("path").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """pages written as bundles into folder (a new one in the shared folder, if none is given) and read back: what read_bundles returns.

    A null html is an empty payload; a null page_id comes last, and is a revisit where another page has its payload; repeated
    rows are records of their own. An empty table gives an empty result.
    """
    return read_bundles(write_bundles(pages, folder))
