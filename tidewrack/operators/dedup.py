"""Document identity, exact and near duplicates: the batch form of one-by-one deduplication."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from math import ceil, comb, log, log1p
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.corpusweights import CorpusWeights, weighted_signatures_of
from tidewrack.functions.corpusweights import learn as learn_weights
from tidewrack.functions.hashing import hashedshingles, shingles, signatures_of, weighted_signature, xxh3_64_hex, xxh3_128_hex
from tidewrack.functions.text import nfkc
from tidewrack.session import cut

try:  # half the time of OpenSSL's for a few bytes
    from _md5 import md5
except ImportError:
    from hashlib import md5

THRESHOLD, MOST_THRESHOLD, TIGHT = 32, 40, 12
GUARD_RATIO, GUARD_TOKENS = 0.5, 200
BANDS, BAND_BITS = 16, 8
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def normalized_for_hash(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and white space as a blank, blanks as one. The compatibility form (NFKC) comes before, where texts are not ASCII."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^0-9a-z\s]", " "), r"\s+", " "))


def content_hash(text: Column) -> Column:
    """The portable content hash: md5 of the normalized text."""
    return F.md5(normalized_for_hash(text).cast("binary"))


def content_hash_xxh3(text: Column) -> Column:
    """The content hash in 16 hexadecimal digits of XXH3, of the NFKC form."""
    return xxh3_64_hex(normalized_for_hash(nfkc(text)))


def doc_id_xxh3(url: Column, content: Column) -> Column:
    return xxh3_128_hex(F.concat(F.coalesce(url, F.lit("")), F.lit("::"), content))


def capture_id_xxh3(doc: Column, observed: Column, locator: Column) -> Column:
    return xxh3_128_hex(F.concat_ws("|", doc, observed, F.coalesce(locator, F.lit(""))))


def doc_id_for(url: Column, content: Column) -> Column:
    return F.md5(F.concat(F.coalesce(url, F.lit("")), F.lit("::"), content).cast("binary"))


def capture_id_for(doc: Column, observed: Column, locator: Column) -> Column:
    return F.md5(F.concat_ws("|", doc, observed, F.coalesce(locator, F.lit(""))).cast("binary"))


def signature(normal: str) -> tuple[int, int] | None:
    """Two signed halves of the 128-bit signature of a normalized text; None without words."""
    return _signature_of(normal.encode())


def _signature_of(raw: bytes) -> tuple[int, int] | None:
    _, starts, lengths = shingles(raw, 3)
    if not len(starts):
        return None
    digests = np.frombuffer(b"".join([md5(raw[a:b], usedforsecurity=False).digest() for a, b in zip(starts.tolist(), (starts + lengths).tolist())]), dtype=np.uint8).reshape(-1, 16)
    if len(digests) < 200:
        ones = np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
    else:  # how often each byte value stands in each place tells all its bits
        ones = np.concatenate([np.bincount(digests[:, k], minlength=256) @ _BYTE_BITS for k in range(16)])
    hi, lo = np.packbits(2 * ones >= len(digests)).view(">i8").tolist()
    return hi, lo


@F.arrow_udf(T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())]))
def _signatures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in texts:
        got = [signature(x or "") for x in part.to_pylist()]
        halves = [pa.array([g and g[k] for g in got], pa.int64()) for k in (0, 1)]
        yield pa.StructArray.from_arrays(halves, ["hi", "lo"])


def signatures(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, hi, lo: 128-bit signatures of three-word shingles, from md5 bits, each occurrence +1 or -1, a bit where the sum is not negative.

    Counted in numpy inside the row: nothing is exploded or shuffled. A text of one or two words is one shingle. The function
    is marked so that a filter by its result stays above it, as it would else be worked out twice.
    """
    once = _signatures.asNondeterministic()
    return df.select(key, once(normalized_for_hash(F.col(text))).alias("s")).select(key, "s.hi", "s.lo")


def weighted_signatures(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, hi, lo, simhash64: 128-bit signatures of Murmur3 bits, distinct shingles weighted by 1 + ln(1 + their number), and plain 64-bit ones."""
    return df.select(key, signatures_of(normalized_for_hash(nfkc(F.col(text)))).alias("s")).select(key, "s.hi", "s.lo", "s.simhash64")


def corpus_weighted_signatures(df: DataFrame, weights: CorpusWeights | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, hi, lo: 128-bit signatures in which shingles that many documents share count for less. weights are learnt from df if none are given."""
    normal = normalized_for_hash(nfkc(F.col(text)))
    signed = weighted_signatures_of(learn_weights(df, normal) if weights is None else weights)
    return df.select(key, signed(normal).alias("s")).select(key, "s.hi", "s.lo")


_WORD_BYTES = bytes(k if chr(k) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for k in range(256))


def normal_bytes(text: str) -> bytes:
    """normalized_for_hash of a text, in UTF-8: its runs of a-z and 0-9, with a blank between."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_WORD_BYTES).split())


def _token_sketch_of(normal: bytes) -> tuple[str | None, int | None]:
    tokens = sorted(set(normal.split()))
    return (md5(b" ".join(tokens), usedforsecurity=False).hexdigest(), len(tokens)) if tokens else (None, None)


#: Texts that a worker holds in all their forms at once.
PIECE_ROWS = 500


def _fingerprints(weighted: bool):
    """hi, lo of signatures or weighted_signatures, and token_hash, token_count of token_sketch, in one pass over the texts."""
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("token_hash", pa.string()), ("token_count", pa.int64())])

    def of(texts: list[str]) -> list[tuple]:
        normal = [normal_bytes(x) for x in texts]
        if weighted:
            composed = [n if x.isascii() else normal_bytes(unicodedata.normalize("NFKC", x)) for x, n in zip(texts, normal)]
            signed = [weighted_signature(a, b) if len(a) else None for a, b in hashedshingles([n.decode() for n in composed])]
        else:
            signed = [_signature_of(n) for n in normal]
        return [(*(s or (None, None)), *_token_sketch_of(n)) for s, n in zip(signed, normal)]

    @F.arrow_udf("hi long, lo long, token_hash string, token_count long")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = [r for k in range(0, len(part), PIECE_ROWS) for r in of([x or "" for x in part.slice(k, PIECE_ROWS).to_pylist()])]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema.names)

    return run


def hamming(hi_a: str, lo_a: str, hi_b: str, lo_b: str) -> Column:
    return F.bit_count(F.col(hi_a).bitwiseXOR(F.col(hi_b))) + F.bit_count(F.col(lo_a).bitwiseXOR(F.col(lo_b)))


def band_rows(sigs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, seg, seg_value: sixteen bands of eight bits. Two signatures within Hamming 15 share one for certain."""
    part = lambda c, k: F.shiftrightunsigned(F.col(c), 8 * k).bitwiseAND(F.lit(255)).cast("int")
    bands = F.array(*[F.struct(F.lit(s).alias("seg"), part("lo" if s < 8 else "hi", s % 8).alias("v")) for s in range(BANDS)])
    return sigs.filter("hi IS NOT NULL").select(key, F.explode(bands).alias("b")).select(key, "b.seg", F.col("b.v").alias("seg_value"))


def token_sketch(text: Column) -> Column:
    """Struct of the hash of the sorted distinct tokens, and their number."""
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(normalized_for_hash(text), " "), lambda t: t != "")))
    return F.struct(F.when(F.size(tokens) > 0, F.md5(F.array_join(tokens, " ").cast("binary"))).alias("token_hash"), F.nullif(F.size(tokens), F.lit(0)).alias("token_count"))


def guard_allows(hash_a: Column, count_a: Column, hash_b: Column, count_b: Column) -> Column:
    """Whether texts may be merged: token numbers within half, and the same tokens where both are short."""
    close = F.abs(count_a - count_b) / F.greatest(count_a, count_b) <= GUARD_RATIO
    short = (count_a <= GUARD_TOKENS) & (count_b <= GUARD_TOKENS)
    return F.coalesce(close & (~short | (hash_a == hash_b)), F.lit(True))


def exact_decisions(df: DataFrame, arrival: str = "observed_ts") -> DataFrame:
    """capture_id, decision, first_doc: NEW, REVISION (same document) or EXACT_DUP by content hash, in order of arrival."""
    first = df.groupBy("content_hash").agg(F.min(F.struct(arrival, "capture_id", "doc_id")).alias("f"))
    rows = df.join(first, "content_hash")
    decision = F.when(F.col("capture_id") == F.col("f.capture_id"), "NEW").when(F.col("doc_id") == F.col("f.doc_id"), "REVISION").otherwise("EXACT_DUP")
    return rows.select("capture_id", decision.alias("decision"), F.col("f.doc_id").alias("first_doc"))


#: Rows of one side that a task compares, and rows of a numpy tile.
PART_ROWS, TILE_ROWS = 4096, 256
#: Buckets of more than one part that are told to all tasks; more of them are joined by key.
TOLD_BUCKETS = 100_000
#: Share of the neighbours at the threshold that samples of bits are to find, and what a row of a sample costs, in comparisons.
RECALL, ROW_COST = 0.9, 1000
SIGNATURE_BITS = 128


def meeting_chance(width: int, distance: int, bits: int = SIGNATURE_BITS) -> float:
    """Chance that signatures at that distance agree in `width` bits drawn without return."""
    return comb(bits - distance, width) / comb(bits, width)


def expected_recall(width: int, samples: int, distance: int) -> float:
    """Share of the pairs at that distance that meet in one of the samples at least."""
    return 1 - (1 - meeting_chance(width, distance)) ** samples


def sampling_plan(rows: int, distance: int = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(width, samples): how many bits a sample has and how many samples there are, so that pairs at the distance meet with the
    recall, and rows are compared least; (0, 1), all with all, where that costs no more or a recall of 1 is asked for.

    A wider sample has smaller buckets but is agreed on less often, so more of them are taken: the recall stays, at any size.
    """
    best, cost = (0, 1), ROW_COST + rows / 2
    for width in range(1, SIGNATURE_BITS - distance + 1) if recall < 1 else ():
        samples = ceil(log(1 - recall) / log1p(-meeting_chance(width, distance)))
        if samples * (ROW_COST + rows / 2**width / 2) < cost:
            best, cost = (width, samples), samples * (ROW_COST + rows / 2**width / 2)
        if samples * ROW_COST > cost:
            break
    return best


def sample_masks(width: int, samples: int, seed: int = 0) -> list[tuple[int, int]]:
    """The bits of each sample, as signed masks of both halves; the same for a seed, and a longer list begins like a shorter one."""
    draw = Random(f"{seed}:{width}")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [sum(1 << k for k in draw.sample(range(SIGNATURE_BITS), width)) for _ in range(samples)]
    return [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in masks]


def sample_rows(sigs: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """sigs: nid, hi, lo. nid, hi, lo, seg, key_hi, key_lo: each row once for each sample, with the sample's bits of it."""
    at = F.array(*[F.struct(F.lit(k).alias("seg"), F.lit(h).cast("long").alias("h"), F.lit(m).cast("long").alias("l")) for k, (h, m) in enumerate(masks)])
    rows = sigs.select("nid", "hi", "lo", F.explode(at).alias("b"))
    return rows.select("nid", "hi", "lo", "b.seg", F.col("hi").bitwiseAND(F.col("b.h")).alias("key_hi"), F.col("lo").bitwiseAND(F.col("b.l")).alias("key_lo"))


def nearest_before(nid: np.ndarray, bits: np.ndarray, late: np.ndarray, early: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(nid, distance, nid of the other) of each of the late rows: the nearest of the early rows with a smaller nid, ties by nid, within most bits. bits: (n, 2) uint64."""
    late, early = late[np.argsort(nid[late])], early[np.argsort(nid[early])]
    late_nid, early_nid = nid[late], nid[early]
    (a_hi, a_lo), (b_hi, b_lo) = np.ascontiguousarray(bits[late].T), np.ascontiguousarray(bits[early].T)
    # memory for a tile is taken once and is small enough for a core's cache
    shape = min(TILE_ROWS, len(late)), min(TILE_ROWS, len(early))
    words, ones, more = np.empty(shape, dtype=np.uint64), np.empty(shape, dtype=np.uint8), np.empty(shape, dtype=np.uint8)
    for k in range(0, len(late), TILE_ROWS):
        own = slice(k, min(k + TILE_ROWS, len(late)))
        own_nid = late_nid[own]
        best = np.full(len(own_nid), most + 1, dtype=np.uint8)
        other = np.full(len(own_nid), -1, dtype=np.int64)
        for j in range(0, len(early), TILE_ROWS):
            if early_nid[j] >= own_nid[-1]:
                break
            them = slice(j, min(j + TILE_ROWS, len(early)))
            tile = slice(0, len(own_nid)), slice(0, them.stop - j)
            x, d, e = words[tile], ones[tile], more[tile]
            np.bitwise_count(np.bitwise_xor(a_hi[own, None], b_hi[None, them], out=x), out=d)
            np.bitwise_count(np.bitwise_xor(a_lo[own, None], b_lo[None, them], out=x), out=e)
            np.add(d, e, out=d)
            if early_nid[them.stop - 1] >= own_nid[0]:
                d[early_nid[None, them] >= own_nid[:, None]] = SIGNATURE_BITS + 1
            found = d.min(axis=1)
            nearer = np.flatnonzero(found < best)
            if len(nearer):
                best[nearer], other[nearer] = found[nearer], early_nid[j + d[nearer].argmin(axis=1)]  # the first of equals is the earliest
        for i in np.flatnonzero(other >= 0).tolist():
            yield int(own_nid[i]), int(best[i]), int(other[i])


def _nearest(most: int):
    schema = pa.schema([("nid", pa.int64()), ("d", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, i, j, part, nid, hi, lo) come ordered by the first three; one such pair of parts, of bounded size, is held at a time."""
        held = np.zeros((0, 7), dtype=np.int64)

        def compared(rows: np.ndarray) -> list[tuple[int, int, int]]:
            nid, bits, part = rows[:, 4], np.ascontiguousarray(rows[:, 5:7]).view(np.uint64).reshape(-1, 2), rows[:, 3]
            every = np.arange(len(rows))
            i, j = int(rows[0, 1]), int(rows[0, 2])
            if i == j:
                return list(nearest_before(nid, bits, every, every, most))
            a, b = every[part == i], every[part == j]
            return [*nearest_before(nid, bits, a, b, most), *nearest_before(nid, bits, b, a, most)]

        def told(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], schema=schema)

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)], axis=1)
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]))
            yield told([x for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()) if b - a > 1 for x in compared(rows[a:b])])
            held = rows[starts[-1] :]
        if len(held) > 1:
            yield told(compared(held))

    return run


def nearest_earlier(sigs: DataFrame, most: int, recall: float = RECALL) -> DataFrame:
    """sigs: nid (in order of arrival), hi, lo; a table that has been cut. nid, d, other: the nearest earlier row within most bits, of those that agree in a sample of bits.

    The samples follow from the number of rows, so that a pair at `most` bits meets with the recall, and nearer ones more
    surely; a recall of 1 compares all with all. Rows that agree in a sample are dealt as pairs of parts to many tasks, so
    none meets in one task.
    """
    dealt = sample_rows(sigs, sample_masks(*sampling_plan(sigs.count(), most, recall)))
    # a bucket is told by a hash: if two share one, more is compared, and nothing is lost
    dealt = dealt.select(F.xxhash64("seg", "key_hi", "key_lo").alias("bucket"), "nid", "hi", "lo")
    large = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > PART_ROWS)
    large = cut(large.select("bucket", F.ceil(F.col("n") / PART_ROWS).cast("long").alias("parts")))
    dealt = dealt.join(F.broadcast(large) if large.count() <= TOLD_BUCKETS else large, "bucket", "left").fillna(1, ["parts"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    dealt = dealt.withColumn("pair", F.explode(pair)).select("bucket", "pair.i", "pair.j", "part", "nid", "hi", "lo")
    # with the number of partitions left to Spark, small ones are joined
    ordered = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = ordered.mapInArrow(_nearest(most), "nid long, d long, other long")
    return found.groupBy("nid").agg(F.min(F.struct("d", "other")).alias("m")).select("nid", "m.d", "m.other")


def near_decisions(df: DataFrame, threshold: int = THRESHOLD, arrival: str = "observed_ts", weighted: bool = False, recall: float = RECALL) -> DataFrame:
    """All decisions, with dup_group: a new document that is nearest to an earlier one, within the threshold and past the guard, joins its group.

    weighted takes weighted_signatures, else the portable ones, which SQL can check.
    The nearest earlier neighbour is the only candidate and roots never move, so groups are chains of pointers; they
    are followed by doubling. Neighbours at the threshold are found with the recall at any number of rows (see
    nearest_earlier), nearer ones more surely, and all of them with a recall of 1; only the nearest leaves a task.
    """
    threshold = max(0, min(threshold, MOST_THRESHOLD))
    exact = cut(exact_decisions(df, arrival))
    fresh = df.join(exact.filter("decision = 'NEW'").select("capture_id"), "capture_id", "left_semi")
    # written before it is sorted, as a sort reads its input twice
    made = fresh.select("capture_id", "doc_id", F.col(arrival).alias("at"), _fingerprints(weighted)(F.col("text")).alias("s"))
    fresh = cut(made.select("capture_id", "doc_id", "at", "s.*"))
    # sorted as a whole, so that numbers rise with arrival
    new = cut(fresh.orderBy(F.col("at").asc_nulls_first(), "capture_id").select(F.monotonically_increasing_id().alias("nid"), "capture_id", "doc_id", "hi", "lo", "token_hash", "token_count"))
    nearest = nearest_earlier(new.select("nid", "hi", "lo").filter("hi IS NOT NULL"), threshold, recall)
    own = new.select("nid", "token_hash", "token_count")
    other = new.select(F.col("nid").alias("other"), F.col("token_hash").alias("b_hash"), F.col("token_count").alias("b_count"))
    allowed = guard_allows(F.col("token_hash"), F.col("token_count"), F.col("b_hash"), F.col("b_count"))
    links = cut(nearest.join(own, "nid").join(other, "other").filter(allowed).select("nid", F.col("other").alias("parent"), F.col("d").alias("distance")))
    while True:
        up = links.select(F.col("nid").alias("parent"), F.col("parent").alias("above"))
        links = cut(links.join(up, "parent", "left").select("nid", F.coalesce("above", "parent").alias("parent"), "distance", F.col("above").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    tops = new.select(F.col("nid").alias("parent"), F.col("doc_id").alias("root"))
    roots = new.select("nid", "capture_id", "doc_id").join(links.join(tops, "parent").select("nid", "root", "distance"), "nid", "left")
    roots = cut(roots.select("capture_id", "doc_id", F.coalesce("root", "doc_id").alias("root"), "distance"))
    by_doc = roots.groupBy("doc_id").agg(F.min("root").alias("dup_group"))
    near = roots.filter("distance IS NOT NULL").select("capture_id", "distance")
    out = exact.join(by_doc.withColumnRenamed("doc_id", "first_doc"), "first_doc", "left").join(near, "capture_id", "left")
    return out.select("capture_id", F.when((F.col("decision") == "NEW") & F.col("distance").isNotNull(), "NEAR_DUP").otherwise(F.col("decision")).alias("decision"), F.coalesce("dup_group", "first_doc").alias("dup_group"), F.col("distance").cast("int").alias("distance"))


def stored(decisions: DataFrame) -> DataFrame:
    """What is kept: no exact duplicates, no revisions, no near duplicates within the tight distance."""
    return decisions.filter(~F.col("decision").isin("EXACT_DUP", "REVISION") & ~((F.col("decision") == "NEAR_DUP") & (F.col("distance") <= TIGHT)))


def dedup_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("content_hash").alias("distinct_hashes"), F.count("*").alias("captures"))


def false_positive_rate(bits: int, threshold: int) -> float:
    """Chance that two random signatures lie within the threshold."""
    return sum(comb(bits, k) for k in range(threshold + 1)) / 2**bits


def calibrated_threshold(bits: int, rate: float) -> int:
    """The largest threshold whose false positive rate is at most rate; -1 if none is."""
    found = -1
    while found < bits and false_positive_rate(bits, found + 1) <= rate:
        found += 1
    return found
