from time import process_time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import dedup


def test_tiles_are_compared_fast():
    bits = np.random.default_rng(3).integers(0, 2**63, (10_000, 2)).astype(np.uint64)
    bits[9_000] = bits[4_000] ^ np.uint64(5)
    every, began = np.arange(len(bits)), process_time()
    assert list(dedup.nearest_before(every, bits, every, every, 16)) == [(9_000, 4, 4_000)]
    assert process_time() - began < 1.5


TEXTS = ["", "   ", "one", "Two  words", "Ein Ärger, İstanbul 12K\n\ttab\x0bfeed\x0c 😀".encode("utf-16", "surrogatepass").decode("utf-16"), "ﬁne ½ ＡＢ３ x² ﬁne ½ ＡＢ３ x²", "a b " * 300, "same same same", " wide blank\u0085x"]


@pytest.mark.parametrize("weighted", [False, True])
def test_fingerprints_are_signatures_and_sketches(spark, weighted):
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*TEXTS, None])], "doc_id long, text string")
    made = df.select("doc_id", dedup._fingerprints(weighted)(F.col("text")).alias("s")).select("doc_id", "s.*")
    signed = (dedup.weighted_signatures if weighted else dedup.signatures)(df).select("doc_id", "hi", "lo")
    told = df.select("doc_id", dedup.token_sketch(F.col("text")).alias("s")).select("doc_id", "s.*")
    assert {r.doc_id: tuple(r)[1:] for r in made.collect()} == {r.doc_id: tuple(r)[1:] for r in signed.join(told, "doc_id").collect()}


def test_large_buckets_joined_by_key_or_told_are_the_same(spark, monkeypatch):
    rows = [(k, k % 7, k % 11) for k in range(300)]
    df = dedup.cut(spark.createDataFrame(rows, "nid long, hi long, lo long"))
    monkeypatch.setattr(dedup, "PART_ROWS", 20)
    found = []
    for told in (0, 100_000):
        monkeypatch.setattr(dedup, "TOLD_BUCKETS", told)
        found.append(sorted(map(tuple, dedup.nearest_earlier(df, 32).collect())))
    assert found[0] == found[1] and len(found[0]) == 299 and found[0][-1] == (299, 0, 68)
