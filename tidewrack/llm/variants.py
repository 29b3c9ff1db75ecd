"""Spelling variants: words one edit apart, by an inverted index of positional q-grams.

A word with its edges padded has a q-gram at every position. An edit destroys at most q neighbouring ones, so words one
edit apart share all but q of the longer word's, at the same positions or, past an insertion, one further on: the count
filter. Of two grams that do not overlap one edit leaves at least one, so a word reads postings for two such grams only,
those with the shortest postings, once for words of its length and once for words one longer.

The index is distributed by (length, gram, position). Counts of postings in a table of fixed size tell every task which
grams to read, and into how many parts a long posting, or a posting with many readers, is to be dealt. A task reads the
postings of its keys for all that ask, applies the count filter, and hands each word its postings of likely partners in
order; they are merged by a heap under the word, and what the merge gives is verified. All links come out, each once.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import cut, release, shuffle_partitions, text_or_empty

RUN_PATTERN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, RATIO, DROP_EVERY = 5, 3, 2, 97
GRAM = 4
#: Distinct words of one task counted before they are handed on.
COUNTED_WORDS = 200_000
#: Bits of the table of posting counts, words of a part of a posting, and pairs compared at once.
SKETCH_BITS, PART_WORDS, PAIRS = 20, 2_048, 400_000

_LOWER = {c: c + 32 for c in range(65, 91)}
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


# ---- words and their counts ------------------------------------------------------------------------------------------


def _misspelt(run: str, h: int) -> str:
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counter(drop_every: int, min_chars: int):
    pattern = re.compile(RUN_PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(pattern.findall(text.translate(_LOWER))).items():
                    h = zlib.crc32(word.encode(), seed) if drop_every else 1
                    if drop_every and h % drop_every == 0:
                        word = _misspelt(word, h)
                    if len(word) >= min_chars:
                        counts[word] += n
                if len(counts) > COUNTED_WORDS:
                    yield handed()
                    counts.clear()
        yield handed()

    return run


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """docs: doc_id, text. (word, n): runs of letters in lower case (A-Z only), counted over whole texts.

    A run whose crc32 with its document's id is divisible by drop_every loses one code point first (0: none does). A null
    id is spelt null, a null text has no words.
    """
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    partial = docs.select(ids.alias("id"), text_or_empty().alias("text")).mapInArrow(_counter(drop_every, min_chars), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- positional grams ------------------------------------------------------------------------------------------------


def _codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), length)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram of each padded word, positions from 0."""
    n, length = codes.shape
    padded = np.zeros((n, length + 2 * (gram - 1)), dtype=np.uint64)
    padded[:, gram - 1 : gram - 1 + length] = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros((n, length + gram - 1), dtype=np.uint64)
    for k in range(gram):
        h = (h ^ padded[:, k : k + length + gram - 1]) * _M[k % 3]
        h ^= h >> np.uint64(29)
    return h


def _keys(hashes: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Posting keys of grams at positions in words of that length."""
    k = (hashes + position.astype(np.uint64)[None, :] * _M[0] + np.uint64(length * int(_M[1]) % (1 << 64))) * _M[3]
    return k ^ (k >> np.uint64(31))


def apart(cost: np.ndarray, gram: int) -> np.ndarray:
    """For each row the two positions, at least `gram` apart, whose costs are least together."""
    n, width = cost.shape
    best, first = cost[:, 0].copy(), np.zeros(n, dtype=np.int64)
    total = np.full(n, np.iinfo(np.int64).max)
    out = np.zeros((n, 2), dtype=np.int64)
    for j in range(gram, width):
        nearer = cost[:, j - gram] < best
        best, first = np.where(nearer, cost[:, j - gram], best), np.where(nearer, j - gram, first)
        less = best + cost[:, j] < total
        total = np.where(less, best + cost[:, j], total)
        out[less, 0], out[less, 1] = first[less], j
    return out


def _reads(hashes: np.ndarray, length: int, gram: int, sketch: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length of the words looked for, their posting keys) that each word reads: two grams of its own length; two at two positions each of one more."""
    at = np.arange(hashes.shape[1])
    mask = np.uint64(len(sketch) - 1)
    same, here, after = _keys(hashes, at, length), _keys(hashes, at, length + 1), _keys(hashes, at + 1, length + 1)
    size = lambda k: sketch[(k & mask).astype(np.int64)]
    row = np.arange(len(hashes))[:, None]
    a, b = apart(size(same), gram), apart(size(here) + size(after), gram)
    return [(length, same[row, a]), (length + 1, np.concatenate([here[row, b], after[row, b]], axis=1))]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    words = batch.column("word").to_pylist()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, [words[r] for r in rows.tolist()]


def _bucket_counts(gram: int, bits: int, read_by):
    """Counts of keys by bucket: of all postings, or, given how they are counted, of what is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.int64)
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            for length, _, words in _by_length(batch):
                hashes = gram_hashes(_codes(words, length), gram)
                if read_by is None:
                    keys = [_keys(hashes, np.arange(hashes.shape[1]), length)]
                else:
                    keys = [k for _, k in _reads(hashes, length, gram, read_by.value)]
                for k in keys:
                    counts += np.bincount((k & mask).astype(np.int64).reshape(-1), minlength=1 << bits)
        found = np.flatnonzero(counts)
        for a in range(0, len(found), 65_536):
            part = found[a : a + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["bucket", "n"])

    return run


def _sketch(words: DataFrame, gram: int, bits: int, read_by=None) -> np.ndarray:
    """2**bits counts, whatever the number of words."""
    rows = words.select("word").mapInArrow(_bucket_counts(gram, bits, read_by), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


# ---- postings and their readers --------------------------------------------------------------------------------------

_DEALT = pa.schema([("length", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("reader", pa.bool_()), ("wid", pa.int64()), ("n", pa.int64()), ("word", pa.string())])
_DEALT_COLUMNS = "length int, key long, i int, j int, reader boolean, wid long, n long, word string"


def _dealt(gram: int, bits: int, part_words: int, postings, reads):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Posting entries that are read by any, and readers. Entries are dealt to parts i of a posting, readers to parts j; each goes to all parts of the other."""
        held, read = postings.value, reads.value
        mask = np.uint64((1 << bits) - 1)

        def rows(length: int, keys: np.ndarray, word: np.ndarray, reader: bool, wid: np.ndarray, n: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
            bucket = (keys & mask).astype(np.int64)
            wanted = read[bucket] > 0 if not reader else held[bucket] > 0
            keys, word, bucket = keys[wanted], word[wanted], bucket[wanted]
            parts_i, parts_j = -(-held[bucket] // part_words), -(-read[bucket] // part_words)
            copies = parts_i if reader else parts_j
            own = (wid[word].astype(np.uint64) * _M[3] >> np.uint64(33)).astype(np.int64) % (parts_j if reader else parts_i)
            at = np.repeat(np.arange(len(keys)), copies)
            other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            i, j = (other, own[at]) if reader else (own[at], other)
            columns = [np.full(len(at), length, dtype=np.int32), keys[at].view(np.int64), i.astype(np.int32), j.astype(np.int32), np.full(len(at), reader), wid[word[at]], n[word[at]]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], words.take(pa.array(word[at]))], schema=_DEALT)

        for batch in batches:
            every_wid, every_n = batch.column("wid").to_numpy(), batch.column("n").to_numpy()
            for length, at, words in _by_length(batch):
                hashes = gram_hashes(_codes(words, length), gram)
                wid, n, said = every_wid[at], every_n[at], pa.array(words, pa.string())
                number = np.arange(len(words))
                own = _keys(hashes, np.arange(hashes.shape[1]), length)
                yield from rows(length, own.reshape(-1), np.repeat(number, own.shape[1]), False, wid, n, said)
                for other, keys in _reads(hashes, length, gram, held):
                    yield from rows(other, keys.reshape(-1), np.repeat(number, keys.shape[1]), True, wid, n, said)

    return run


def _whole(equal: np.ndarray, before: bool, after: bool, gram: int) -> np.ndarray:
    """equal: whether code points agree, pair by pair. For each gram whether all of it agrees; before and after: whether the padding does."""
    n, length = equal.shape
    padded = np.empty((n, length + 2 * (gram - 1)), dtype=bool)
    padded[:, : gram - 1], padded[:, gram - 1 : gram - 1 + length], padded[:, gram - 1 + length :] = before, equal, after
    out = padded[:, : length + gram - 1].copy()
    for k in range(1, gram):
        out &= padded[:, k : k + length + gram - 1]
    return out


def shared_grams(short: np.ndarray, long: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Rows of code points, pair by pair, of one length, or the second one longer: how many grams of the first the second has at the same position, or one further on."""
    if short.shape[1] == long.shape[1]:
        return _whole(short == long, True, True, gram).sum(axis=1)
    here = _whole(short == long[:, :-1], True, False, gram)
    return (here | _whole(short == long[:, 1:], False, True, gram)).sum(axis=1)


_PARTNERS = pa.schema([("wid", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("partners", pa.list_(pa.struct([("wid", pa.int64()), ("word", pa.string()), ("n", pa.int64())])))])
_PARTNER_COLUMNS = "wid long, word string, n long, partners array<struct<wid:long,word:string,n:long>>"


def _read_postings(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by length, key and parts. Each reader's partners that pass the count filter, by posting, ordered by wid."""
        held: list[pa.RecordBatch] = []
        tail: tuple | None = None

        def read(table: pa.Table) -> Iterator[pa.RecordBatch]:
            lengths = table["length"].to_numpy()
            for length in np.unique(lengths).tolist():
                yield from one_length(length, table.filter(pa.array(lengths == length)) if len(np.unique(lengths)) > 1 else table)

        def one_length(length: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(axis=1)]))
            reader, wid, n = t["reader"].to_numpy(), t["wid"].to_numpy(), t["n"].to_numpy()
            words = t["word"].to_pylist()
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            entries = np.flatnonzero(~reader)
            first = np.searchsorted(group[entries], np.arange(group[-1] + 2))
            codes = np.zeros((len(words), length), dtype=np.uint32)
            for size in (length - 1, length):
                rows = np.flatnonzero(sizes == size)
                if len(rows) and size:
                    codes[rows, :size] = _codes([words[r] for r in rows.tolist()], size)
            for size in (length - 1, length):
                asking = np.flatnonzero(reader & (sizes == size))
                meets = first[group[asking] + 1] - first[group[asking]]
                asking, meets = asking[meets > 0], meets[meets > 0]
                upto = np.cumsum(meets)
                a = 0
                while a < len(asking):
                    b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
                    x = np.repeat(asking[a:b], meets[a:b])
                    within = np.arange(len(x)) - np.repeat(upto[a:b] - meets[a:b] - (upto[a] - meets[a]), meets[a:b])
                    y = entries[np.repeat(first[group[asking[a:b]]], meets[a:b]) + within]
                    a = b
                    if size == length:
                        fresh = wid[y] > wid[x]
                        x, y = x[fresh], y[fresh]
                    passed = shared_grams(codes[x, :size], codes[y], gram) >= length - 1
                    x, y = x[passed], y[passed]
                    if len(x):
                        yield handed(x, y, wid, n, words)

        def handed(x: np.ndarray, y: np.ndarray, wid: np.ndarray, n: np.ndarray, words: list[str]) -> pa.RecordBatch:
            order = np.lexsort((wid[y], x))
            x, y = x[order], y[order]
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            partners = pa.StructArray.from_arrays([pa.array(wid[y]), pa.array([words[k] for k in y.tolist()], pa.string()), pa.array(n[y])], names=["wid", "word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)).astype(np.int32)), partners)
            own = x[starts]
            return pa.RecordBatch.from_arrays([pa.array(wid[own]), pa.array([words[k] for k in own.tolist()], pa.string()), pa.array(n[own]), lists], schema=_PARTNERS)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("length", "key", "i", "j")]
            held.append(batch)
            size += batch.num_rows
            if size >= 20_000:
                table = pa.Table.from_batches(held)
                last = np.ones(table.num_rows, dtype=bool)
                for c, v in zip(("length", "key", "i", "j"), ends):
                    last &= table[c].to_numpy() == v
                begins = table.num_rows - int(last.sum())
                if begins:
                    yield from read(table.slice(0, begins))
                    held = table.slice(begins).combine_chunks().to_batches()
                    size = table.num_rows - begins
        if held:
            yield from read(pa.Table.from_batches(held))

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def merged(word: str, postings: list[list[tuple]]) -> Iterator[tuple]:
    """Postings (wid, word, n), each in order, merged by a heap: every entry that is one edit away, once."""
    last = None
    for entry in heapq.merge(*postings):
        if entry[0] != last:
            last = entry[0]
            if one_edit(word, entry[1]):
                yield entry


_LINKS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for word, n, postings in zip(*[batch.column(c).to_pylist() for c in ("word", "n", "postings")]):
            for _, other, m in merged(word, [[(p["wid"], p["word"], p["n"]) for p in posting] for posting in postings]):
                out += [(word, n, other, m), (other, m, word, n)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _LINKS)], schema=_LINKS)


def near_words(words: DataFrame, gram: int = GRAM, bits: int = SKETCH_BITS, part_words: int = PART_WORDS) -> DataFrame:
    """words: distinct word, n. Links (word, n, other, other_n) between words exactly one edit apart, each in both directions.

    Words have two code points at least (shorter ones would share no gram), or a ValueError is raised. A word reads at most
    six postings, and has no more partners than its length allows, so what is gathered under it is bounded.
    """
    spark = words.sparkSession
    rows = cut(words.select(F.monotonically_increasing_id().alias("wid"), "word", "n"))
    if rows.filter(F.length("word") < 2).limit(1).count():
        raise ValueError("words need two code points")
    share = spark.sparkContext.broadcast
    postings = share(_sketch(rows, gram, bits))
    reads = share(_sketch(rows, gram, bits, postings))
    dealt = rows.mapInArrow(_dealt(gram, bits, part_words, postings, reads), _DEALT_COLUMNS)
    met = dealt.repartition(shuffle_partitions(spark), "length", "key", "i", "j").sortWithinPartitions("length", "key", "i", "j")
    found = met.mapInArrow(_read_postings(gram), _PARTNER_COLUMNS)
    asked = found.groupBy("wid").agg(F.first("word").alias("word"), F.first("n").alias("n"), F.collect_list("partners").alias("postings"))
    return asked.select("word", "n", "postings").mapInArrow(_merge, "word string, n long, other string, other_n long")


# ---- forms -----------------------------------------------------------------------------------------------------------


def rooted(forms: DataFrame) -> DataFrame:
    """forms: word, form. (word, root): the last form of each, by doubling. Counts grow along forms, so there are no circles."""
    tree = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        up = tree.select(F.col("word").alias("root"), F.col("root").alias("above"))
        tree = cut(tree.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if tree.filter("moved").isEmpty():
            return tree.select("word", "root")
        tree = tree.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = RATIO, gram: int = GRAM, bits: int = SKETCH_BITS, part_words: int = PART_WORDS) -> DataFrame:
    """words: distinct word, n; a table that has been cut. word, form, root, n, n_near, form_n of each.

    A word's form is its near word of largest n, ties to the smaller in code-point order, if that is ratio times its own n
    at least, else null; root follows forms to the last, and is the word itself where there is none.
    """
    links = near_words(words, gram, bits, part_words)
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form")))
    near = cut(links.groupBy("word").agg(F.first("n").alias("own"), F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", F.when(-F.col("best.m") >= ratio * F.col("own"), F.col("best.form")).alias("form"), (-F.col("best.m")).alias("form_n")))
    release(words.sparkSession)
    roots = rooted(near.filter("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY, ratio: int = RATIO) -> DataFrame:
    """docs: doc_id, text. The words of all texts (see word_counts) with their variant groups (see variant_groups).

    Null and empty texts have no words, repeated rows and ids count as often as they stand there, very long texts and words
    are read whole, and an empty table gives an empty one. Other columns are ignored.
    """
    return variant_groups(cut(word_counts(docs, min_chars, min_count, drop_every)), ratio)
