"""Token ids packed into rows of fixed length, as binary files.

Texts are encoded by a byte-level byte-pair vocabulary. A text longer than a row is split into whole rows and a rest,
without loss; rests and short texts are packed by best fit decreasing: the longest first, each into the row with the
least room that still takes it. Rows are found by a segment tree over capacities, which knows for every range of
capacities whether a row has one of them. Each task packs blocks of bounded size on its own, so nothing is shuffled,
and writes a file for each block into the folder that all executors share: the id matrix, cumulative segment lengths
for each row, and the flat places at which positions begin anew. The checkpointed file names are the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import cut, shared_subdir, text_or_empty

VOCABULARY = "byte_bpe_50k.tiktoken"
PAD = 50256
ROW_TOKENS = 2048
#: Tokens of a block at least, but for the last of a task.
BLOCK_TOKENS = 4_000_000
KEPT_CHUNKS = 600_000

_WS = "\t-\r \x85\xa0  -     　"
#: Stretches that the vocabulary's pattern never crosses: a space with what follows it, or a run of white space.
_CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class ByteEncoder:
    """Encodes texts by chunks, keeping what chunks give as little-endian 16-bit ids."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        chunks = _CHUNKS.findall(text)
        got = list(map(self.known.get, chunks))
        if None in got:
            if len(self.known) > KEPT_CHUNKS:
                self.known.clear()
            for k, raw in enumerate(got):
                if raw is None:
                    c = chunks[k]
                    raw = self.known.get(c)
                    if raw is None:
                        raw = np.array(self.encoding.encode_ordinary(c), dtype="<u2").tobytes()
                        if len(c) <= 64:
                            self.known[c] = raw
                    got[k] = raw
        return np.frombuffer(b"".join(got), dtype="<u2")

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class CapacityTree:
    """Rows by the room that is left in them, 0 to `most`, with a search for the least room of a size or more."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = self.leaves + room
        while k and not self.any[k]:
            self.any[k] = 1
            k //= 2

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of `size` or more, which is taken out."""
        k = self.leaves + size
        while not self.any[k]:
            while k & 1:  # a right child: up, until there is a right neighbour
                k //= 2
            if not k:
                return None
            k += 1
        while k < self.leaves:
            k *= 2
            if not self.any[k]:
                k += 1
        room = k - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[k] = 0
            k //= 2
            while k and not (self.any[2 * k] or self.any[2 * k + 1]):
                self.any[k] = 0
                k //= 2
        return room, row


def best_fit(lengths: list[int], row_tokens: int) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Rows of (document, first token, tokens), and their number, for documents of the given lengths."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for doc, n in enumerate(lengths):
        whole = n // row_tokens
        rows += [[(doc, k * row_tokens, row_tokens)] for k in range(whole)]
        if n > whole * row_tokens:
            rests.append((n - whole * row_tokens, doc, whole * row_tokens))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree = CapacityTree(row_tokens)
    for size, doc, first in rests:
        got = tree.take(size)
        if got is None:
            rows.append([])
            got = (row_tokens, len(rows) - 1)
        room, row = got
        rows[row].append((doc, first, size))
        if room > size:
            tree.put(room - size, row)
    return rows, len(rows)


def pack(ids: list[np.ndarray], row_tokens: int = ROW_TOKENS, pad: int = PAD) -> dict[str, np.ndarray]:
    """The arrays of a block. ids: (rows, row_tokens); cu_seqlens with row_ptr: the ends of each row's segments, from 0;
    resets: flat places where a segment, and so its positions, begin; doc, first, size, row, at: each segment."""
    rows, n = best_fit([len(x) for x in ids], row_tokens)
    matrix = np.full((n, row_tokens), pad, dtype="<u2")
    cu, ptr, resets, segments = [], [0], [], []
    for k, row in enumerate(rows):
        at = 0
        cu.append(0)
        for doc, first, size in row:
            matrix[k, at : at + size] = ids[doc][first : first + size]
            resets.append(k * row_tokens + at)
            segments.append((doc, first, size, k, at))
            at += size
            cu.append(at)
        ptr.append(len(cu))
    columns = np.array(segments, dtype=np.int64).reshape(-1, 5)
    return {"ids": matrix, "cu_seqlens": np.array(cu, np.int32), "row_ptr": np.array(ptr, np.int64), "resets": np.array(resets, np.int64)} | {name: columns[:, k] for k, name in enumerate(("doc", "first", "size", "row", "at"))}


def positions(block: dict[str, np.ndarray]) -> np.ndarray:
    """The position of each token of the matrix inside its segment; padding counts on."""
    flat = np.arange(block["ids"].size)
    begin = np.zeros(block["ids"].size, dtype=np.int64)
    begin[block["resets"]] = block["resets"]
    return (flat - np.maximum.accumulate(begin)).reshape(block["ids"].shape)


def unpack(block: dict[str, np.ndarray], documents: int) -> list[np.ndarray]:
    """The ids of each document of a block again."""
    sizes = np.bincount(block["doc"], weights=block["size"], minlength=documents).astype(np.int64)
    out = [np.empty(n, dtype="<u2") for n in sizes]
    for doc, first, size, row, at in zip(*[block[k].tolist() for k in ("doc", "first", "size", "row", "at")]):
        out[doc][first : first + size] = block["ids"][row, at : at + size]
    return out


def _writer(folder: str, path: str, row_tokens: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        attempt = TaskContext.get().taskAttemptId()
        system, base = fs.FileSystem.from_uri(folder)
        done: list[tuple] = []
        names: list[int | None] = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> None:
            block = pack(held, row_tokens)
            file = io.BytesIO()
            missing = np.array([x is None for x in names])
            np.savez(file, **block, doc_ids=np.array([0 if x is None else x for x in names], np.int64), missing=missing)
            name = f"block-{attempt}-{len(done)}.npz"
            with system.open_output_stream(f"{base}/{name}.part") as f:
                f.write(file.getbuffer())
            system.move(f"{base}/{name}.part", f"{base}/{name}")
            done.append((f"{folder}/{name}", len(names), len(block["ids"]), tokens))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist()):
                names.append(doc_id)
                held.append(encoder.encode(text))
                tokens += len(held[-1])
                if tokens >= block_tokens:
                    flush()
                    names, held, tokens = [], [], 0
        if names:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "documents", "rows", "tokens"])

    return run


def write_packed(docs: DataFrame, folder: str | None = None, path: str | None = None, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs: doc_id, text. Writes the blocks; returns the manifest (path, documents, rows, tokens). A null text counts as empty, which has no segment."""
    spark = docs.sparkSession
    folder = folder or shared_subdir(spark, "packed")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("t"))
    return cut(rows.mapInArrow(_writer(folder, path or default_path(), row_tokens, block_tokens), "path string, documents long, rows long, tokens long"))


def read_block(path: str) -> dict[str, np.ndarray]:
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return dict(np.load(io.BytesIO(f.read())))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_tokens", "n_segments", "ids_sha256"]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            block = read_block(path)
            ids = unpack(block, len(block["doc_ids"]))
            segments = np.bincount(block["doc"], minlength=len(ids))
            shas = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            doc_ids = pa.array(block["doc_ids"], pa.int64(), mask=block["missing"])
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array(segments, pa.int64()), pa.array(shas, pa.string())], names=names)


def read_packed(manifest: DataFrame) -> DataFrame:
    """A row for each document, put together again from the packed rows: doc_id, n_tokens, n_segments, ids_sha256 (of the ids as little-endian 32-bit numbers)."""
    return manifest.select("path").mapInArrow(_read, "doc_id long, n_tokens long, n_segments long, ids_sha256 string")


def packed(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """docs packed into folder (a new one in the shared folder, if none is given) and put together again: what read_packed returns.

    A null or empty text has no tokens and still has its row, with no segment; overlong texts are split and joined again;
    repeated rows and ids are documents of their own. An empty table gives an empty result.
    """
    return read_packed(write_packed(docs, folder))
