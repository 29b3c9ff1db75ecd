"""Document fingerprints by spot signatures: chains of content words that follow common words.

At each anchor (a common word of four languages) a signature is the anchor with the next content words, a fixed number
of steps apart; the fingerprint of a text is the multiset of its signatures, as sorted 64-bit hashes. A text that has
no complete chain is one signature of all its words, so short texts differ unless they are equal.

Likeness is the Jaccard resemblance of multisets. `near_duplicates` finds all pairs above a threshold: texts are dealt
to partitions of set length, wide enough that a text can only match in its own partition or the next, and within
them by their rarest signatures (a prefix that two likely sets must share), and compared through a Jaccard that ends
as soon as the lengths or the signatures left cannot reach the threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import cut, shuffle_partitions, text_or_empty
from tidewrack.llm.components import connected_components

#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    """
    the of and to in a is that for it with as was on be at by this are or an from which
    le la les de des du et un une est en que qui dans pour par sur au avec il elle
    der die das und ein eine ist zu den von mit auf für im dem nicht sich des
    el los las y es una por con para del se lo su al como más
    """.split()
)
CHAIN = 2
DISTANCE = 1
THRESHOLD = 0.8
KEPT_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """A hash of each word seen; odd for anchors, even for content words."""

    def __missing__(self, word: str) -> int:
        got = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7) >> 1 << 1 | (word in ANCHORS)
        if len(self) > KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


_words = _Words()


def signatures(text: str, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """The sorted signatures of a text, repeats included; none for a text without words."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.array(list(map(_words.__getitem__, words)), dtype=np.uint64)
    anchor = (ids & np.uint64(1)).astype(bool)
    content = ids[~anchor]
    at = np.cumsum(~anchor)[anchor]  # the place of each anchor's next content word
    whole = at + (chain - 1) * distance < len(content)
    sig, at = ids[anchor][whole], at[whole]
    for k in range(chain):
        sig = (sig ^ (sig >> np.uint64(31))) * _A + content[at + k * distance] * _B
    if not len(sig):
        return np.array([xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "replace"), 9)], dtype=np.uint64)
    return np.sort(sig)


def digest(sigs: np.ndarray) -> str:
    """The fingerprint as a string: the number of signatures and a 128-bit hash of them all."""
    return f"{len(sigs)}-{xxhash.xxh3_128_hexdigest(sigs.tobytes())}"


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard resemblance of two sorted multisets; 1 for two empty ones.

    With at_least, 0 as soon as it is known to lie below: by the lengths, or by the signatures left after each stretch.
    """
    if not len(a) and not len(b):
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) < at_least * len(large):
        return 0.0
    need = at_least * (len(a) + len(b)) / (1 + at_least)  # signatures that must be common
    common, step = 0, len(small) if not at_least else max(64, len(small) // 8)
    start = 0
    while start < len(small):
        end = min(start + step, len(small))
        while end < len(small) and small[end] == small[end - 1]:
            end += 1
        values, counts = np.unique(small[start:end], return_counts=True)
        low = np.searchsorted(large, values, "left")
        high = np.searchsorted(large, values, "right")
        common += int(np.minimum(counts, high - low).sum())
        if common + len(small) - end < need - 1e-9:
            return 0.0
        start = end
    return common / (len(a) + len(b) - common)


def length_partition(n: int, threshold: float = THRESHOLD) -> int:
    """The partition of set length: sets of partitions that are more than one apart differ too much in length to match."""
    return math.floor(math.log(max(n, 1)) / -math.log(threshold) + 1e-9)


def alike(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two sorted multisets resemble each other: only those of neighbouring length partitions are compared, as far as the threshold needs."""
    if abs(length_partition(len(a), threshold) - length_partition(len(b), threshold)) > 1:
        return False
    return jaccard(a, b, threshold) >= threshold


def _packer(bounds: list, heads: list):
    """Rows to (bucket, guest, doc_id, tie, n, z): buckets by descending doc_id, each head again as a guest that closes the bucket before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        rising = np.array(bounds[::-1], dtype=np.int64)
        before = {head: bucket for bucket, head in heads}
        for batch in batches:
            ids = batch.column("doc_id")
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = len(rising) - np.searchsorted(rising, values, "right")  # ids above all edges are bucket 0
            bucket[ids.is_null().to_numpy(zero_copy_only=False)] = len(rising)  # null ids come last
            texts = [x or "" for x in batch.column("t").to_pylist()]
            raw = [x.encode("utf-8", "replace") for x in texts]
            guests = [k for k, x in enumerate(ids.to_pylist()) if x in before]
            order = [*range(len(raw)), *guests]
            into = [*bucket.tolist(), *[before[ids[k].as_py()] for k in guests]]
            packed = [press.compress(x) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(into, pa.int32()),
                    pa.array([0] * len(raw) + [1] * len(guests), pa.int32()),
                    ids.take(pa.array(order)),
                    pa.array([xxhash.xxh64_intdigest(raw[k]) >> 1 for k in order], pa.int64()),
                    pa.array([packed[k] for k in order], pa.binary()),
                ],
                names=["bucket", "guest", "doc_id", "tie", "z"],
            )

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the row after it in its bucket; a guest only ends a bucket, and only the first of equal guests counts."""
    expand = zstandard.ZstdDecompressor()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "alike_edited", "alike_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
    held = None

    def compared(row, after) -> tuple:
        doc_id, text, sigs = row[2:]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[3][:k]
        other = signatures(edited) if k else sigs
        sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        return (doc_id, len(text), sha, digest(sigs), digest(other), jaccard(sigs, other), jaccard(sigs, after[4]), alike(sigs, other), alike(sigs, after[4]))

    for batch in batches:
        out = []
        columns = [batch.column(k) for k in ("bucket", "guest", "doc_id", "z")]
        for bucket, guest, doc_id, z in zip(*[c.to_pylist() for c in columns]):
            text = expand.decompress(z).decode()
            row = (bucket, guest, doc_id, text, signatures(text))
            if held is not None and held[0] == bucket and not held[1]:
                out.append(compared((held[0], held[1], held[2], held[3], held[4]), row))
            held = row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)


def fingerprinted(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, alike_edited, alike_next for each row of docs.

    The near columns are whole likenesses; the alike ones tell which are near duplicates, by length partitions and pruned Jaccard.
    The edited text is the text with its last third replaced by the beginning of the next document's text, where
    documents follow one another in descending doc_id, nulls last, repeated ids by a hash of their text, and the first
    follows the last (itself, if it is alone). A null text counts as empty; other columns are ignored.

    Ids are cut into ranges; a range is one sorted partition, and the first document of a range is sent to the range
    before it as well, so that texts move once, compressed, and every pair meets in one partition.
    """
    spark = docs.sparkSession
    count = buckets or shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("t"))
    cuts = rows.approxQuantile("doc_id", [k / count for k in range(1, count)], 0.2 / count) if count > 1 else []
    edges = sorted({int(x) for x in cuts}, reverse=True)  # bucket k holds ids from edges[k] (included) to edges[k-1] (not)
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.coalesce(F.col("doc_id") < e, F.lit(True)))) if edges else F.lit(0)
    tops = sorted((r[0], r[1]) for r in rows.select(place.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    heads = [(tops[k - 1][0], tops[k][1]) for k in range(len(tops))]  # a bucket's first id goes to the bucket before; the very first to the last
    packed = rows.mapInArrow(_packer(edges, heads), "bucket int, guest int, doc_id long, tie long, z binary")
    dealt = packed.repartitionById(len(edges) + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "tie")
    return dealt.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, alike_edited boolean, alike_next boolean")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Returns (doc_id, class_id): classes linked by a resemblance of at least threshold, named by their least doc_id.

    Equal fingerprints are one node, whatever their number. Null texts count as empty; empty fingerprints are one class.
    Candidates are pairs of distinct fingerprints that share a rare signature and a length partition. First each is compared
    with the least one of every such group, which joins most of a group of near copies; then only pairs of a group that are
    not yet in one class are, other than those inside the group's largest class. No registered query calls this.
    """

    @F.arrow_udf("struct<fp:string,sigs:array<long>>")
    def sets(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            found = [signatures(x or "") for x in part.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([digest(s) for s in found], pa.string()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["fp", "sigs"])

    made = cut(docs.select("doc_id", sets(text_or_empty("text")).alias("s")).select("doc_id", "s.fp", "s.sigs"))
    nodes = cut(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("sigs").alias("sigs")).withColumn("node", F.xxhash64("fp")))
    each = nodes.select("node", F.size("sigs").alias("n"), F.explode("sigs").alias("sig")).groupBy("node", "n", "sig").agg(F.count("*").alias("c"))
    spread = each.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1")
    # rarest first; two sets at or above the threshold share a signature among the first n - ceil(t n) + 1 of each
    ranked = each.join(spread, "sig").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig", "c"))).alias("l"), F.sum("c").alias("shared"))
    lonely = F.col("n") - F.col("shared")  # signatures of no other set come first of all
    prefix = F.col("n") - F.ceil(threshold * F.col("n")) + 1
    before = F.aggregate("l", F.struct(lonely.cast("long").alias("seen"), F.array().cast("array<long>").alias("keys")), lambda a, x: F.when(a["seen"] < prefix, F.struct((a["seen"] + x["c"]).alias("seen"), F.concat(a["keys"], F.array(x["sig"])).alias("keys"))).otherwise(a), lambda a: a["keys"])
    part = F.floor(F.log("n") / F.lit(-math.log(threshold)) + 1e-9)  # length_partition
    keys = ranked.select("node", "n", part.alias("part"), F.explode(before).alias("key"))
    both = cut(keys.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1))))

    @F.arrow_udf("boolean")
    def near(a: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in a:
            yield pa.array([alike(np.array(p, np.int64).view(np.uint64), np.array(q, np.int64).view(np.uint64), threshold) for p, q in zip(x.to_pylist(), y.to_pylist())])

    su, sv = nodes.select(F.col("node").alias("u"), F.col("sigs").alias("su")), nodes.select(F.col("node").alias("v"), F.col("sigs").alias("sv"))

    def linked(pairs: DataFrame) -> DataFrame:
        """u, un, v, vn: the pairs that resemble each other."""
        fit = F.least("un", "vn") >= threshold * F.greatest("un", "vn")
        known = pairs.filter((F.col("u") != F.col("v")) & fit).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        return cut(known.join(su, "u").join(sv, "v").filter(near("su", "sv")).select("u", "v"))

    heads = both.groupBy("key", "part").agg(F.min(F.struct("node", "n")).alias("h")).select("key", "part", F.col("h.node").alias("u"), F.col("h.n").alias("un"))
    first = linked(both.select("key", "part", F.col("node").alias("v"), F.col("n").alias("vn")).join(heads, ["key", "part"]))
    known = connected_components(first)
    classed = cut(both.join(known, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root"))
    sizes = classed.groupBy("key", "part", "class").agg(F.count("*").alias("c")).groupBy("key", "part").agg(F.max_by("class", F.struct("c", "class")).alias("largest"), F.count("*").alias("classes")).filter("classes > 1")
    mixed = classed.join(cut(sizes.select("key", "part", "largest")), ["key", "part"])
    small = mixed.filter(F.col("class") != F.col("largest")).select("key", "part", F.col("node").alias("u"), F.col("n").alias("un"), F.col("class").alias("uc"))
    other = mixed.select("key", "part", F.col("node").alias("v"), F.col("n").alias("vn"), F.col("class").alias("vc"))
    second = linked(small.join(other, ["key", "part"]).filter("uc <> vc").select("u", "un", "v", "vn"))
    roots = connected_components(first.union(second))
    rooted = nodes.select("fp", "node", "least").join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    labels = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    return made.select("doc_id", "fp").join(rooted.join(labels, "root").select("fp", "class_id"), "fp").select("doc_id", "class_id")
