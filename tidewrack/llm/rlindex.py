"""Exact removal of long repeated passages with a run-length compressed index.

What is removed are the bytes covered by a string of LENGTH bytes that also starts elsewhere in the corpus. Each such
string has one anchor: the place of its least hashed 32 bytes, which equal strings have at the same offset. The strings
with one anchor are a segment of text. Anchors that only one place has cannot repeat. Of segments that are equal by hash
two are taken, and all segments that share an anchor are indexed together, whether they are equal or differ:

* the suffixes of the different ones are sorted and the Burrows-Wheeler transform is run-length compressed: a symbol and a
  length for each run, where a suffix counts as often as its segment stands there; the suffix positions at the heads and
  ends of runs are kept as samples;
* the longest match of each suffix with the suffix before it is computed at the samples only, and streamed through the
  text from there: inside a run it shrinks by one from one position to the next. With the samples at run ends the same
  holds for the suffix after it. The larger of the two is the matching statistic of the position against all others;
* a position whose matching statistic is LENGTH or more begins a repeated string.

Hashes only choose what is indexed together; what repeats is told by the matching statistics of the bytes. What is found
in one segment holds for all that are equal to it.

No group need be larger than one index: where many different segments share an anchor, each is cut into runs of strings
that hold the anchor at nearly the same depth, and what all strings of such a run have in common becomes a longer
anchor. Equal strings get equal longer anchors, so nothing is lost; runs are indexed like segments, and only those that
still share too much are cut again, down to single strings. Texts move once, compressed, and are checkpointed with their
partitioning; later joins bring places to texts, not texts to places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import cut, join_by_hot_keys, release, remove, shared_subdir, shuffle_partitions, text_or_empty

LENGTH = 400
ANCHOR = 32
#: Texts are hashed in pieces of so many bytes, with an overlap.
PIECE = 1 << 20
#: Bytes that one index gathers, and different segments of an anchor beyond which the anchor is made longer.
INDEX_BYTES = 1_000_000
MOST_SEGMENTS = 2_048
#: Depths of the anchor that the strings of one run have, from cut to cut.
DEPTHS = (64, 8, 1)

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]
_POS_BITS = np.uint64(22)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number."""
    n = len(data) - 7
    return np.lib.stride_tricks.as_strided(data, shape=(n, 8), strides=(1, 1)).copy().view(np.uint64).reshape(n)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _M[4]
    h ^= h >> np.uint64(29)
    return h


def _stretch_hashes(words: np.ndarray, n: int, size: int) -> np.ndarray:
    """A hash of the `size` bytes (a multiple of 8) from each of n positions."""
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size // 8):
        h += words[8 * k : 8 * k + n] * _M[k % 4]
        h ^= h >> np.uint64(27)
        h *= _M[(k + 1) % 4]
    return _mix(h)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, by running minima of blocks from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, length: int = LENGTH, anchor: int = ANCHOR, piece: int = PIECE) -> Iterator[tuple[int, int, int, int]]:
    """(hash of the anchor, its place, first start, last start) for each run of strings with one anchor.

    The anchor of a string is the leftmost place of the least hash of `anchor` bytes in it, so it depends on the
    string alone. anchor must be a multiple of 8.
    """
    for begin in range(0, max(0, len(raw) - length + 1), piece):
        data = np.frombuffer(raw, dtype=np.uint8, count=min(piece + length - 1, len(raw) - begin), offset=begin)
        words = _words(data)
        n = len(data) - anchor + 1
        h = _stretch_hashes(words, n, anchor)
        packed = (h & ~((np.uint64(1) << _POS_BITS) - np.uint64(1))) | np.arange(n, dtype=np.uint64)
        at = (_window_min(packed, length - anchor + 1) & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.append(starts[1:], len(at)) - 1
        for a, p, x, y in zip(h[at[starts]].view(np.int64).tolist(), at[starts].tolist(), starts.tolist(), ends.tolist()):
            yield a, begin + p, begin + x, begin + y


def suffix_order(text: np.ndarray, packed: np.ndarray | None = None, left: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of a text of non-negative numbers, by doubling. The end sorts before all symbols.

    packed, if given, has the first eight symbols of each suffix as one number, zeros behind the end of its segment, and
    left tells suffixes with less than eight symbols apart, in their order and before all others. A suffix has the rank of
    the first place that its equals so far take; once it is alone there, it is not sorted again.
    """
    n = len(text)
    if packed is None:
        key, step = text, 1
    else:
        order = np.argsort(packed)
        ordered = packed[order]
        key = np.empty(n, dtype=np.int64)
        key[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        key, step = key * (int(left.max()) + 2) + left, 8
    order = np.argsort(key)
    heads = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    ranks = np.empty(n, dtype=np.int64)
    ranks[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    while True:
        live = np.flatnonzero(~(heads & np.append(heads[1:], True)))
        if not len(live):
            return order
        at = order[live]
        after = np.where(at + step < n, ranks[np.minimum(at + step, n - 1)] + 1, 0)
        key = ranks[at] * (n + 2) + after
        by = np.argsort(key)
        at, key = at[by], key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        order[live], heads[live] = at, fresh
        ranks[at] = np.maximum.accumulate(np.where(fresh, live, 0))
        step *= 2


class RunLengthIndex:
    """Run-length compressed Burrows-Wheeler transform of different segments, each ended by a symbol of its own, with samples at run heads and ends.

    copies: how often each segment stands in the collection. Suffixes of its copies are neighbours, so they lengthen runs
    and need not be sorted.
    """

    def __init__(self, segments: list[bytes], copies: list[int] | None = None):
        lengths = np.array([len(s) + 1 for s in segments], dtype=np.int64)
        self.copies = np.array(copies or [1] * len(segments), dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        text = np.empty(int(self.ends[-1]), dtype=np.int64)
        flat = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8)
        text[:] = flat.astype(np.int64) + len(segments)
        text[self.ends - 1] = np.arange(len(segments))
        self.text = text
        owner = np.repeat(np.arange(len(segments)), lengths)
        rest = np.repeat(self.ends - 1, lengths) - np.arange(len(text))  # symbols before the end of the segment
        padded = np.concatenate([flat, np.zeros(8, dtype=np.uint8)])
        words = _words(padded)[: len(text)].byteswap()
        short = np.maximum(8 - rest, 0).astype(np.uint64) * np.uint64(8)
        words = np.where(rest > 0, words >> short << short, np.uint64(0)) if len(text) else words
        left = np.where(rest < 8, rest * len(segments) + owner, 8 * len(segments))
        order = suffix_order(text, words, left)
        bwt = text[order - 1]  # the byte before each suffix, cyclically
        heads = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        head = np.flatnonzero(heads)
        end = np.append(head[1:], len(bwt)) - 1
        self.run_symbols = bwt[head]
        self.run_lengths = np.add.reduceat(self.copies[owner[order]], head)
        before = order[np.maximum(head - 1, 0)]
        after = order[np.minimum(end + 1, len(order) - 1)]
        self.head_samples = (order[head], np.where(head > 0, before, -1))
        self.end_samples = (order[end], np.where(end + 1 < len(order), after, -1))
        self.twins = self.copies > 1
        self.twin = np.repeat(self.twins, lengths)

    def _common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, up to most; 0 where b is -1."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(b >= 0)
        text, n = self.text, len(self.text)
        width = 16
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            i = np.arange(width)
            left = text[np.minimum(x[:, None] + i, n - 1)]
            right = text[np.minimum(y[:, None] + i, n - 1)]
            same = (left == right) & (x[:, None] + i < n) & (y[:, None] + i < n)
            k = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[live] += k
            live = live[(k == width) & (out[live] < most)]
        return out

    def _streamed(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        known = np.zeros(len(self.text), dtype=np.int64)
        known[at] = lengths
        sampled = np.zeros(len(self.text), dtype=bool)
        sampled[at] = True
        place = np.arange(len(self.text))
        last = np.maximum.accumulate(np.where(sampled, place, 0))
        return np.maximum(known[last] - (place - last), 0)

    def matching_statistics(self, most: int) -> np.ndarray:
        """For each position (of the first copy) the longest match with any other position. Matches of `most` and more are told apart only from shorter ones."""
        at, before = self.head_samples
        earlier = self._streamed(at, self._common(at, before, most))
        at, after = self.end_samples
        # the suffix after one with copies is the copy's, which is as long; that holds from the start of the segment on
        once = ~self.twin[at]
        starts = self.begins[self.twins]
        at, after = at[once], after[once]
        later = self._streamed(np.concatenate([at, starts]), np.concatenate([self._common(at, after, most), (self.ends - 1 - self.begins)[self.twins]]))
        return np.maximum(earlier, later)


def repeated_starts(segments: list[bytes], copies: list[int] | None = None, length: int = LENGTH) -> list[np.ndarray]:
    """Different segments, and how often each stands there. For each the starts of strings of `length` bytes that start elsewhere too."""
    index = RunLengthIndex(segments, copies)
    # streamed values fall by one a position, so matches are measured to the longest segment, not only to `length`
    found = index.matching_statistics(max(map(len, segments))) >= length
    return [np.flatnonzero(found[a : b - 1]) for a, b in zip(index.begins.tolist(), index.ends.tolist())]


def shared_stretches(segments: list[bytes], groups: list[int], length: int = LENGTH, part: int = ANCHOR) -> list[list[tuple[int, int]]]:
    """For each segment the first and last starts of strings that can repeat in its group: all of a fixed quarter of their stretches of `part` bytes occur twice there.

    No string that repeats is lost; what an edit has changed goes, before anything is indexed.
    """
    flat = np.frombuffer(b"".join(segments) + bytes(8), dtype=np.uint8)
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    h = _stretch_hashes(_words(flat), len(flat) - part - 7, part)
    group = np.repeat(np.array(groups, dtype=np.uint64), sizes)[: len(h)]
    seen = np.flatnonzero((h & np.uint64(3)) == 0)
    end = np.repeat(begins + sizes, sizes)
    seen = seen[seen + part <= end[seen]]  # not across segments
    key = h[seen] ^ (group[seen] * _M[1])
    order = np.argsort(key)
    ordered = key[order]
    alone = np.ones(len(key), dtype=bool)
    if len(key) > 1:
        same = ordered[1:] == ordered[:-1]
        alone[order[1:]] &= ~same
        alone[order[:-1]] &= ~same
    bad = np.zeros(len(flat) + 1, dtype=np.int64)
    bad[seen[alone] + 1] = 1
    bad = np.cumsum(bad)
    out = []
    for at, n in zip(begins.tolist(), sizes.tolist()):
        starts = np.arange(at, at + n - length + 1)
        out.append(_runs(np.flatnonzero(bad[starts + length - part + 1] == bad[starts])) if len(starts) else [])
    return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], gaps + 1])].tolist(), starts[np.append(gaps, len(starts) - 1)].tolist()))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [press.compress((x or "").encode("utf-8", "replace")) for x in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(z, pa.binary())], names=["rid", "doc_id", "z"])


def _hash(raw: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        names = ["anchor", "content", "rid", "start", "last", "deep"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for rid, z in zip(batch.column("rid").to_pylist(), batch.column("z").to_pylist()):
                raw = expand.decompress(z)
                for a, p, x, y in anchors(raw, length):
                    for column, value in zip(out, (a, _hash(raw[x : y + length]), rid, x, y, p - x)):
                        column.append(value)
                if len(out[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return run


#: A segment: its anchor, the hash of its bytes, where the anchor lies in it, and the bytes.
_SEGMENT = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("deep", pa.int64()), ("segment", pa.binary())])
_SEGMENT_COLUMNS = "anchor long, content long, deep long, segment binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wanted segments of each text."""
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, wanted in zip(*[batch.column(k).to_pylist() for k in ("z", "wanted")]):
                raw = expand.decompress(z)
                out += [(w["anchor"], w["content"], w["deep"], raw[w["start"] : w["last"] + length]) for w in wanted]
            if out:
                yield _batch(out, _SEGMENT)

    return run


def longer_anchors(anchor: int, start: int, last: int, deep: int, segment: bytes, width: int, length: int = LENGTH, part: int = ANCHOR) -> Iterator[tuple[int, int, int, int, bytes]]:
    """A segment cut into runs of strings that hold the anchor at depths of one range of `width`: (longer anchor, start, last, deep, segment) of each.

    deep is how far behind the start of the first string the anchor lies. The longer anchor is a hash of the old one, the
    range, and the bytes that every string with the anchor at such a depth has.
    """
    first = start
    while first <= last:
        depth = deep - (first - start)
        shallow = depth // width * width  # the range: shallow to shallow + width - 1, as far as strings go
        end = min(last, first + depth - shallow)
        widest = min(shallow + width - 1, length - part)
        common = segment[deep - shallow : deep - widest + length]
        yield _hash(common, (anchor * 0x9E3779B97F4A7C15 + shallow) % (1 << 64)), first, end, depth, segment[first - start : end - start + length]
        first = end + 1


#: A run of a segment: where it begins in that, and the run as a segment of its own.
_RUN = pa.schema([("above_anchor", pa.int64()), ("above", pa.int64()), ("offset", pa.int64()), *_SEGMENT])
_RUN_COLUMNS = "above_anchor long, above long, offset long, " + _SEGMENT_COLUMNS


def _longer(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, content, deep, segment in zip(*[batch.column(f.name).to_pylist() for f in _SEGMENT]):
                out += [(a, content, x, k, _hash(s, 1), d, s) for k, x, _, d, s in longer_anchors(a, 0, len(segment) - length, deep, segment, width, length)]
            if out:
                yield _batch(out, _RUN)

    return run


_MARKS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_MARK_COLUMNS = "anchor long, content long, a long, b long"


def repeated_places(rows: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """rows: (group, segment); segments of a group share an anchor. For each the first and last starts of strings that repeat.

    Segments are trimmed to what can repeat; equal stretches are indexed once, with their number.
    """
    stretches = shared_stretches([r[1] for r in rows], [r[0] for r in rows], length)
    parts = [(k, a, b) for k, runs in enumerate(stretches) for a, b in runs]
    by_content: dict[tuple[int, bytes], list[int]] = {}
    for n, (k, a, b) in enumerate(parts):
        by_content.setdefault((rows[k][0], rows[k][1][a : b + length]), []).append(n)
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    if by_content:
        for same, starts in zip(by_content.values(), repeated_starts([c for _, c in by_content], [len(x) for x in by_content.values()], length)):
            runs = _runs(starts)
            for n in same:
                k, a, _ = parts[n]
                out[k] += [(a + x, a + y) for x, y in runs]
    return out


def _index_places(length: int, index_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by anchor. Whole anchors are gathered up to the size of an index; what repeats comes out, by segment."""
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = repeated_places([(r[0] % (1 << 64), r[2]) for r in rows], length)
            out = list(dict.fromkeys((anchor, content, a, b) for (anchor, content, _), runs in zip(rows, found) for a, b in runs))
            if out:
                yield _batch(out, _MARKS)

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in ("anchor", "content", "segment")]):
                if size > index_bytes and held[-1][0] != row[0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield from flush(held)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
    for batch in batches:
        out = []
        for doc_id, z, places in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "z", "places")]):
            raw = expand.decompress(z)
            spans: list[list[int]] = []
            for p in sorted((p["start"], p["stop"]) for p in places or ()):
                if spans and p[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], p[1])
                else:
                    spans.append(list(p))
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            left = b"".join([*kept, raw[at:]])
            out.append((doc_id, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left, spans))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)


class _Tables:
    """Tables in the shared folder: written, read again, and deleted when what was made from them is there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.folders[name] = shared_subdir(self.spark, name)
        df.write.parquet(self.folders[name])
        release(self.spark)  # the shuffles behind it can go
        return self.spark.read.parquet(self.folders[name])

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.folders.pop(name))


def _marks(segments: DataFrame, kinds: DataFrame, tables: _Tables, length: int, index_bytes: int, most_segments: int, depths: tuple[int, ...]) -> DataFrame:
    """segments: of each content under an anchor one or two. kinds: anchor, kinds (different contents). (anchor, content, a, b): first and last starts that repeat."""
    parts = shuffle_partitions(segments.sparkSession)

    def indexed(rows: DataFrame) -> DataFrame:
        met = rows.select("anchor", "content", "segment").repartition(parts, "anchor").sortWithinPartitions("anchor", "content")
        return met.mapInArrow(_index_places(length, index_bytes), _MARK_COLUMNS)

    large = kinds.filter(F.col("kinds") > most_segments) if depths else kinds.limit(0)
    if large.isEmpty():
        return indexed(segments)
    level = len(tables.folders)
    runs = tables.written(segments.join(large, "anchor", "left_semi").mapInArrow(_longer(length, depths[0]), _RUN_COLUMNS), f"runs-{level}")
    at = F.struct("above_anchor", "above", "offset")
    contents = tables.written(runs.groupBy("anchor", "content").agg(F.count("*").alias("m"), F.min(at).alias("low"), F.max(at).alias("high")), f"run-contents-{level}")
    below = tables.written(contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("m").alias("m")).filter("m > 1"), f"run-kinds-{level}")
    # two of each content: both copies of one run, or the first and the last of several
    chosen = runs.join(contents.join(below.select("anchor"), "anchor", "left_semi"), ["anchor", "content"]).filter((at == F.col("low")) | (at == F.col("high")))
    chosen = tables.written(chosen.select(*_SEGMENT.names), f"run-segments-{level}")
    found = tables.written(_marks(chosen, below, tables, length, index_bytes, most_segments, depths[1:]), f"run-marks-{level}")
    places = runs.select("anchor", "content", "above_anchor", "above", "offset").distinct()
    mapped = places.join(found, ["anchor", "content"]).select(F.col("above_anchor").alias("anchor"), F.col("above").alias("content"), (F.col("offset") + F.col("a")).alias("a"), (F.col("offset") + F.col("b")).alias("b"))
    return indexed(segments.join(large, "anchor", "left_anti")).unionByName(mapped)


def repeats_removed(docs: DataFrame, length: int = LENGTH, index_bytes: int = INDEX_BYTES, most_segments: int = MOST_SEGMENTS, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """docs: doc_id, text. One row each: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and what is kept and the removed spans.

    A null text counts as empty, a text shorter than length loses nothing; repeated rows and ids are texts of their own, so
    long equal texts vanish entirely. Texts may be of any length and are read in pieces; an empty table gives an empty one.
    Other columns are ignored. docs may be read in any order: rows are numbered once.
    most_segments is how many different segments of one anchor an index holds before their anchors are made longer, by
    depths, each of which must divide the one before; with 1 as the last, strings under one anchor are equal.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("t"))
    texts = cut(rows.mapInArrow(_pack, "rid long, doc_id long, z binary").repartition(shuffle_partitions(spark), "rid"))
    release(spark)  # the shuffle of the texts is not needed again
    tables = _Tables(spark)
    found = tables.written(texts.mapInArrow(_anchor_rows(length), "anchor long, content long, rid long, start long, last long, deep long"), "anchors")
    shared = tables.written(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeated-anchors")
    near = tables.written(found.join(shared, "anchor", "left_semi"), "shared-anchors")
    tables.drop("anchors", "repeated-anchors")
    at = F.struct("rid", "start", "last", "deep")
    contents = tables.written(near.groupBy("anchor", "content").agg(F.count("*").alias("m"), F.min(at).alias("low"), F.max(at).alias("high")), "contents")
    kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds"))
    two = F.explode(F.when(F.col("m") > 1, F.array("low", "high")).otherwise(F.array("low")))
    wanted = contents.select("anchor", "content", two.alias("at")).groupBy("at.rid").agg(F.collect_list(F.struct("anchor", "content", "at.start", "at.last", "at.deep")).alias("wanted"))
    segments = texts.join(wanted, "rid").select("z", "wanted").mapInArrow(_segments(length), _SEGMENT_COLUMNS)
    large = tables.written(kinds.filter(F.col("kinds") > most_segments), "large-anchors")
    if not large.isEmpty():
        segments = tables.written(segments, "segments")
    marks = _marks(segments, large, tables, length, index_bytes, most_segments, depths)
    marks = tables.written(marks.groupBy("anchor", "content").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "marks")
    key = F.struct("anchor", "content").alias("key")
    keyed = marks.join(contents.select("anchor", "content", "m"), ["anchor", "content"]).select(key, F.col("m").alias("n"), "runs")
    placed = join_by_hot_keys(near.select(key, "rid", "start"), tables.written(keyed, "keyed-marks"), "key")
    placed = placed.select("rid", "start", F.explode("runs").alias("run")).select("rid", (F.col("start") + F.col("run.a")).alias("start"), (F.col("start") + F.col("run.b") + length).alias("stop"))
    places = tables.written(placed, "places")
    tables.drop(*[name for name in tables.folders if name != "places"])
    places = places.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("places"))
    return texts.join(places, "rid", "left").select("doc_id", "z", "places").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")
