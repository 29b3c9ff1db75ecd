"""The pipeline against the same steps by brute force, and its stages on odd tables."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewrack.llm import bpe, classifier, mixing, secrets, simhash
from tests.llm.test_operators import ODD, WORD, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_equals_brute_force(spark, tmp_path):
    base = prose(150)
    texts = [prose(60) for _ in range(60)] + [base, base, base + " the"] + ["password: abcdefgh12345678 " + prose(60)] + [" ".join(w + "###" for w in prose(60).split()) for _ in range(30)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int("###" not in t), 0) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    weights = classifier.fit(docs, labels)
    left = [r for r in rows if classifier.score(r[1], weights) >= classifier.THRESHOLD]
    assert {r[0] for r in left} == set(range(64))
    fps = {r[0]: simhash.fingerprint(r[1].encode()) for r in left}
    parent = {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in fps:
        for b in fps:
            if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    left = [r for r in left if find(r[0]) == r[0]]
    vocabulary = secrets.vocabulary(secrets.default_path())
    left = [(r[0], secrets.redacted(r[1], secrets.scan(r[1], vocabulary)[1]), r[3]) for r in left]
    assert any("[secret]" in t for _, t, _ in left)
    size = Counter()
    for _, t, s in left:
        size[s] += len(WORD.findall(t))
    total, weight = sum(size.values()), {"s0": 5, "s1": 2, "s2": 1, "s3": 5}
    capped: set = set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(w for x, w in weight.items() if x not in capped) for s in size}
        over = {s for s in size if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    expected: Counter = Counter()
    encoder = bpe.TextEncoder(bpe.default_path())
    for s in size:
        budget = int(target[s] + 0.5)
        epochs, partial = divmod(budget, size[s])
        at = 0
        for i, t, _ in sorted((r for r in left if r[2] == s), key=lambda r: hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()):
            n = len(WORD.findall(t))
            taken = epochs * n + max(0, min(n, partial - at))
            at += n
            raw, said = next(encoder.encode([t]))
            expected[i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(said.encode()).hexdigest()] += int(taken / n + 0.5)
    assert Counter(tuple(r)[:4] for r in got) == +expected
    assert all(hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 for r in got)


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    rows = [(k, t, None, "s", None) for k, t in enumerate(ODD)] + [(4, ODD[4], "en", None, 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(k) for k, c in enumerate("size key fp first row doc copies taken scan __row __copies __scan __score".split())})
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "odd"))
    for table in (spark.read.parquet(str(tmp_path / "odd")), spark.read.parquet(str(tmp_path / "odd")).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert out.count() <= 4 * len(rows) and (name == "bpe" or out.columns == docs.columns)
    kept = corpus_pipeline.deduplicate(spark, spark.read.parquet(str(tmp_path / "odd")), str(tmp_path)).collect()
    texts = Counter(r.text for r in kept)
    assert texts[ODD[4]] == 1 and np.isclose(sum(1 for r in kept if not (r.text or "").strip()), 1)


def test_the_mix_is_the_same_though_the_table_is_split_anew_between_reads(spark, tmp_path, monkeypatch):
    rows = [(k, prose(20 + k % 7), "en", f"s{k % 3}", 1) for k in range(60)]
    for k in range(0, 60, 10):
        spark.createDataFrame(rows[k : k + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    want = Counter(map(tuple, mixing.mix(spark.read.parquet(str(tmp_path / "docs"))).collect()))
    real, key = mixing.source_targets, "spark.sql.files.maxPartitionBytes"

    def with_other_splits(*args):
        spark.conf.set(key, "2k")
        return real(*args)

    monkeypatch.setattr(mixing, "source_targets", with_other_splits)
    spark.conf.set(key, "128m")
    try:
        got = Counter(map(tuple, mixing.mix(spark.read.parquet(str(tmp_path / "docs"))).collect()))
    finally:
        spark.conf.unset(key)
    assert got == want and set(got) <= set(rows)


def test_near_duplicates_go_though_the_table_is_split_anew_between_reads(spark, tmp_path, monkeypatch):
    texts = [prose(60) for _ in range(40)]
    rows = [(k, texts[k % 40], "en", "s", 1) for k in range(80)]
    for k in range(0, 80, 10):  # a file every ten rows
        spark.createDataFrame(rows[k : k + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    real, key = simhash.connected_components, "spark.sql.files.maxPartitionBytes"

    def with_other_splits(edges):
        spark.conf.set(key, "2k")  # as when executors are lost or come back
        return real(edges)

    monkeypatch.setattr(simhash, "connected_components", with_other_splits)
    spark.conf.set(key, "128m")
    try:
        kept = simhash.keep_one_of_each(spark.read.parquet(str(tmp_path / "docs"))).collect()
    finally:
        spark.conf.unset(key)
    assert sorted((r.doc_id, r.text) for r in kept) == list(enumerate(texts))


def test_a_worker_holds_the_tables_of_one_operator_and_takes_batches_in_pieces(spark, tmp_path):
    import pyarrow as pa

    from tidewrack.llm import common

    rows = [(k, prose(80), "en", f"s{k % 4}", 1) for k in range(200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).repartition(8)

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [sum(map(bool, (len(classifier._words), secrets.vocabulary.cache_info().currsize, bpe.encoder.cache_info().currsize)))]})

    for stage in (corpus_pipeline.classify, corpus_pipeline.redact, corpus_pipeline.encode):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / stage.__name__))
        counts = [r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()]
        assert 1 == max(counts), (stage.__name__, counts)

    texts = pa.array([t for _, t, *_ in rows] + [None, "", "x" * 5000])
    pieces = list(common.slices(iter([texts, texts.slice(0, 0)]), 4096))
    assert [x for p in pieces for x in p.to_pylist()] == texts.to_pylist()
    assert max(p.nbytes for p in pieces[:-2]) < 3 * 4096 and len(pieces) > 10
