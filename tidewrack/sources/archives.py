"""Archive files by pieces: records of WARC files as a batch, as a stream that resumes inside a file, and as a sink.

A .gz archive has a gzip member for each record, so a piece of a file (a range of bytes) owns the members that begin in it
with a WARC header; a task finds the first of them by the gzip header. Members that begin otherwise continue the one before.
A member that is damaged ends its unit, and reading goes on at the next one with a WARC header. Files of one member, and
those that are not compressed, belong to the piece that has their first byte.
"""

from __future__ import annotations

import gzip
import io
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition

from tidewrack.sources.jsonl_sink import HIDDEN, Chunks, store_of

ENDINGS = (".warc", ".warc.gz", ".wet", ".wet.gz")
SPLIT_BYTES = 128 << 20
_MAGIC, _HEAD = b"\x1f\x8b\x08", b"WARC/"
_READ, _OUT = 1 << 18, 1 << 18


class _Members:
    """A cursor over the gzip members of an open file, from a byte on; pos is where the held compressed bytes begin."""

    def __init__(self, f, first: int):
        self.f, self.pos, self.held = f, first, b""
        f.seek(first)

    def fill(self) -> bool:
        more = self.f.read(_READ)
        self.held += more
        return bool(more)

    def skip_to(self, byte: int) -> None:
        if byte >= self.pos:
            self.held = self.held[byte - self.pos :]
        else:
            self.held = b""
            self.f.seek(byte)
        self.pos = byte

    def opened(self) -> tuple[zlib._Decompress, bytes, bytes] | None:
        """The member that begins here: its decompressor, first bytes, and compressed rest; None if there is none."""
        d, out = zlib.decompressobj(31), b""
        while len(self.held) < len(_MAGIC) and self.fill():
            pass
        if not self.held.startswith(_MAGIC):
            return None
        rest, fed = self.held, len(self.held)
        try:
            while len(out) < len(_HEAD) and not d.eof:
                out += d.decompress(rest, len(_HEAD) - len(out))
                rest = d.unconsumed_tail
                if len(out) < len(_HEAD) and not d.eof and not rest:
                    if not self.fill():
                        break
                    rest, fed = self.held[fed:], len(self.held)
        except zlib.error:
            return None
        return d, out, rest

    def find(self, last: int) -> bool:
        """Moves to the first member at or after here, and before `last`, that begins with a WARC header."""
        while self.pos < last:
            k = self.held.find(_MAGIC)
            if k < 0:
                self.skip_to(self.pos + max(0, len(self.held) - len(_MAGIC) + 1))
                if not self.fill():
                    return False
                continue
            self.skip_to(self.pos + k)
            if self.pos >= last:
                return False
            got = self.opened()
            if got and got[1] == _HEAD:
                return True
            self.skip_to(self.pos + 1)
        return False


class _Unit(io.RawIOBase):
    """The unpacked bytes of one member with a WARC header and of the members that continue it."""

    def __init__(self, members: _Members):
        self.members, self.start, self.out, self.damaged = members, members.pos, b"", False
        self.now = members.opened()

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.out and self.now is not None:
            d, head, rest = self.now
            if head:
                self.out, self.now = head, (d, b"", rest)
            elif d.eof:
                self._next(d)
            else:
                self._unpack(d, rest)
        n = min(len(self.out), len(target))
        target[:n], self.out = self.out[:n], self.out[n:]
        return n

    def _unpack(self, d, rest: bytes) -> None:
        m = self.members
        if not rest:
            m.skip_to(m.pos + len(m.held))  # all of it is in the decompressor
            if not m.fill():
                self.now = None
                return
            rest = m.held
        try:
            self.out = d.decompress(rest, _OUT)
        except zlib.error:
            self.now, self.damaged = None, True
            return
        self.now = (d, b"", d.unconsumed_tail)

    def _next(self, d) -> None:
        m = self.members
        m.skip_to(m.pos + len(m.held) - len(d.unused_data))
        following = m.opened()
        self.now = following if following and following[1] != _HEAD else None


def units(f, first: int, last: int) -> Iterator[tuple[int, io.BufferedReader]]:
    """(first byte, unpacked stream) of the units that begin in [first, last); a stream is to be read to its end before the next."""
    members = _Members(f, first)
    while members.pos < last and members.find(last):
        unit = _Unit(members)
        reader = io.BufferedReader(unit, _OUT)
        yield unit.start, reader
        while reader.read(_OUT):  # what the reader has left
            pass
        if unit.damaged:
            members.skip_to(unit.start + 1)


@dataclass
class Piece(InputPartition):
    path: str
    first: int
    last: int


def records(path: str, piece: Piece) -> Iterator[tuple]:
    """path, first byte of the unit, ordinal in the unit, type, url, payload of the records of a piece."""
    from tidewrack.sources.web import records_of

    if piece.path == "":
        return
    system, _ = store_of(path)
    with system.open_input_file(piece.path) as f:
        found = units(f, piece.first, piece.last) if piece.path.endswith(".gz") else [(0, io.BufferedReader(f, 1 << 20))]
        for start, stream in found:
            for k, (h, body) in enumerate(records_of(stream)):
                yield piece.path, start, k, h.get("warc-type"), h.get("warc-target-uri", "").strip("<>") or None, body


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives in a folder, by path."""
    from pyarrow import fs

    system, base = store_of(path)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(ENDINGS) and HIDDEN not in x.path)


def pieces(files: list[tuple[str, int]], start: tuple[str, int], end: tuple[str, int], split: int) -> list[Piece]:
    """What lies between two offsets (path, byte), dealt in pieces of at most `split` bytes; at least one, which may be empty."""
    found = []
    for path, size in files:
        if start[0] <= path <= end[0]:
            first, last = start[1] if path == start[0] else 0, end[1] if path == end[0] else size
            if path.endswith(".gz"):
                found += [Piece(path, a, min(a + split, last)) for a in range(first, last, split)]
            elif first == 0 < last:
                found.append(Piece(path, 0, size))
    return found or [Piece("", 0, 0)]


class _Split:
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))


class WarcReader(_Split, DataSourceReader):
    def partitions(self) -> list[Piece]:
        files = listed(self.path)
        return pieces(files, ("", 0), files[-1] if files else ("", 0), self.split)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return records(self.path, partition)


class WarcStreamReader(_Split, DataSourceStreamReader):
    """Offsets are (path, byte) in the order of paths. A batch takes all that is there, or batch_bytes of it.

    Files must be whole when they appear, and those that come later must sort after those that are there. batch_bytes is
    for triggers by time; a run with availableNow is one batch of Spark's, so it should take all.
    """

    def __init__(self, options):
        super().__init__(options)
        self.most, self.at = int(options.get("batch_bytes", 0)), ("", 0)

    def initialOffset(self) -> dict:
        return {"path": "", "byte": 0}

    def latestOffset(self) -> dict:
        path, byte = self.at
        left = self.most
        for name, size in listed(self.path):
            if name < path or (name == path and byte >= size):
                continue
            begun = byte if name == path else 0
            path, byte = name, size
            if self.most:
                byte = min(size, begun + left)
                left -= byte - begun
                if left <= 0:
                    break
        return {"path": path, "byte": byte}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """Also called with the last offset of a stream that begins again, before the latest one is asked for."""
        first, last = (start["path"], start["byte"]), (end["path"], end["byte"])
        self.at = max(self.at, last)
        return pieces(listed(self.path), first, last, self.split) if first < last else [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return records(self.path, partition)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, (end["path"], end["byte"]))


class WarcWriter(DataSourceWriter):
    """Rows (record_type, url, payload) as .warc.gz files, a member for each; a file is named when the whole job is done, by its time, so a stream finds it after those before."""

    def __init__(self, options, columns: list[str]):
        self.path, self.bytes = options["path"], int(options.get("bytes", 1 << 30))
        self.places = [columns.index(c) for c in ("record_type", "url", "payload")]

    def write(self, iterator: Iterator) -> Chunks:
        system, base = store_of(self.path)
        system.create_dir(base, recursive=True)
        names, total, file, size = [], 0, None, 0
        for row in iterator:
            kind, url, body = (row[k] for k in self.places)
            body = bytes(body or b"")
            target = f"WARC-Target-URI: {url}\r\n" if url is not None else ""
            head = f"WARC/1.0\r\nWARC-Type: {kind or 'resource'}\r\n{target}WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nContent-Length: {len(body)}\r\n\r\n"
            member = gzip.compress(head.encode() + body + b"\r\n\r\n", 6, mtime=0)
            if file is not None and size + len(member) > self.bytes:
                file.close()
                file = None
            if file is None:
                names.append(f"{HIDDEN}{uuid.uuid4().hex}.warc.gz")
                file, size = system.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
            file.write(member)
            size, total = size + len(member), total + 1
        if file is not None:
            file.close()
        return Chunks(names, total)

    def commit(self, messages: list[Chunks | None]) -> None:
        system, base = store_of(self.path)
        at = f"{time.time_ns():020}"
        for k, chunk in enumerate(c for m in messages if m for c in m.names):
            system.move(f"{base}/{chunk}", f"{base}/{at}-{k:06}.warc.gz")

    def abort(self, messages: list[Chunks | None]) -> None:
        system, base = store_of(self.path)
        for chunk in (c for m in messages if m for c in m.names):
            system.delete_file(f"{base}/{chunk}")


class WarcDataSource(DataSource):
    """spark.read, spark.readStream and df.write (append) with format("tidewrack_warc") and option path; split_bytes for reading."""

    @classmethod
    def name(cls) -> str:
        return "tidewrack_warc"

    def schema(self) -> str:
        return "path string, first_byte long, ordinal long, record_type string, url string, payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def streamReader(self, schema) -> WarcStreamReader:
        return WarcStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options, schema.names)
