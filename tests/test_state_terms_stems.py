"""Stateful streams against one-by-one forms, many terms at once, stems, chunked output."""

import json
import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewrack.functions.manyterms import terms_found
from tidewrack.functions.stemmer import stem, stems
from tidewrack.functions.tokens import matches
from tidewrack.operators import alerts, dedup, search
from tidewrack.sources import datasource, jsonl_sink
from tidewrack.streaming import stateful, streams


def batches(spark, folder, rows, schema, n):
    """rows in n files, one a micro-batch, in order."""
    import os

    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
        for name in os.listdir(f"{folder}/{k}"):
            os.utime(f"{folder}/{k}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    return streams.file_stream(spark, f"{folder}/*", spark.createDataFrame([], schema).schema, 1)


@pytest.mark.parametrize("cap", [1, 3, 5000])
def test_seen_window_equals_one_by_one(spark, tmp_path, cap):
    rng = random.Random(cap)
    rows = [(f"f{rng.randrange(3)}" if k % 50 else None, f"u{rng.randrange(8)}" if k % 40 else None, k) for k in range(400)]
    got = {tuple(r) for r in streams.drained(stateful.seen_window(batches(spark, str(tmp_path), rows, "feed string, url string, position long", 3), cap=cap), "t-window").collect()}
    windows, want = {}, set()
    for feed, url, at in rows:
        if url is None:
            continue
        window = windows.setdefault(feed, OrderedDict())
        if url not in window:
            want.add((feed, url, at))
        window[url] = None
        window.move_to_end(url)
        while len(window) > cap:
            window.popitem(last=False)
    assert got == want


def test_near_links_of_a_stream_equal_those_of_a_table(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(15)]
    sigs = [b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(45))) for b in base for _ in range(12)]
    rng.shuffle(sigs)
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = [(k, signed(x >> 64), signed(x % 2**64)) for k, x in enumerate(sigs)] + [(len(sigs), None, None)]
    schema = "nid long, hi long, lo long"
    plan = (6, 8)
    found = stateful.near_links(batches(spark, str(tmp_path), rows, schema, 3), dedup.sample_masks(*plan), 32)
    got = {tuple(r) for r in stateful.nearest(streams.drained(found, "t-links")).collect()}
    monkeypatch.setattr(dedup, "sampling_plan", lambda *_: plan)
    assert got == {tuple(r) for r in dedup.nearest_earlier(spark.createDataFrame(rows[:-1], schema), 32).collect()} and got


def test_terms_at_once_equal_terms_one_by_one(spark):
    terms = ["us", "Cat", "cat dog", "c++", "a", ".net", "x_1", "sis"]
    texts = ["US cat", "ſus us", "concatenate cat-dog cat dog", "c++ c++x xc++ .net a.net", "a_b A", "İsis sıs SIS", "x_1 x_12", "", None, "Kat", "cat" * 50, "cats\ncat\tdog"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumn("title", F.lit("") if True else None)
    got = {r.k: set(r.found) for r in df.select("k", terms_found(terms, "title", "text").alias("found")).collect()}
    for n, term in enumerate(terms):
        want = {r.k for r in df.filter(matches(term)).collect()}
        assert {k for k, found in got.items() if n in found} == want, term
    with pytest.raises(ValueError):
        terms_found(["é"], "text")


def test_many_rules_count_like_few(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"t{k}", " ".join(rng.choice("alpha beta gamma the c++ Δx".split()) for _ in range(6)), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 14))) for k in range(300)]
    df = spark.createDataFrame(rows, "title string, text string, fetch_ts timestamp_ntz")
    rules = [alerts.Rule(k, t, t, kind, 2, hours) for k, (t, kind, hours) in enumerate((t, kind, hours) for t in ("alpha", "Beta", "beta", "zzz", "c++", "Δx") for kind in ("term_count", "term_spike") for hours in (0.5, 24, 48))]
    now = F.lit(datetime(2024, 1, 14, 12)).cast("timestamp_ntz")
    many = sorted(map(tuple, alerts.evaluated(df, rules, now).collect()))
    monkeypatch.setattr(alerts, "MANY_RULES", 1000)
    assert many == sorted(map(tuple, alerts.evaluated(df, rules, now).collect())) and any(r[3] for r in many)


# Pairs of words and stems of the published sample vocabulary.
SAMPLE = """consign consign consigned consign consignment consign consist consist consistency consist consolation consol consolatory consolatori
consolidating consolid consonant conson conspicuous conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc
knack knack knackeries knackeri knaves knave knavish knavish kneaded knead kneel kneel knees knee knell knell knif knif knightly knight knitted knit
knives knive knocker knocker knopp knopp knots knot banks bank generate generat generously generous relational relat happy happi dying die news news
running run hopping hop hoping hope flies fli cries cri gas gas this this agreed agre luxuriated luxuri rational ration hopefulness hope electricity
electr adjustment adjust communism communism arsenal arsenal succeed succeed boy boy boyish boyish saying say controlling control roll roll""".split()


def test_stems(spark):
    assert [stem(w) for w in SAMPLE[::2]] == SAMPLE[1::2]
    assert stem("été") == "été" and stem("") == "" and stem("is") == "is"
    terms = spark.createDataFrame([("banks",), ("bank",), (None,)], "term string")
    assert {(r.term, r.stem) for r in stems(terms).collect()} == {("banks", "bank"), ("bank", "bank"), (None, None)}
    df = spark.createDataFrame([("a", "Banks", "banking on a bank"), ("b", "x", "nothing")], "capture_id string, title string, text string")
    got = {(r.term, r.capture_id): (r.tf_title, r.tf_text) for r in search.postings(df, stem=stems).collect()}
    assert got["bank", "a"] == (1, 2)


def test_chunks_are_whole_and_rotate(spark, tmp_path):
    datasource.register(spark)
    out = f"file://{tmp_path}/out"
    df = spark.range(2500).select("id", F.concat(F.lit("text é "), F.col("id").cast("string")).alias("text")).coalesce(1)
    df.write.format("tidewrack_jsonl").option("path", out).option("records", 1000).mode("append").save()
    files = sorted((tmp_path / "out").glob("*.jsonl"))
    assert [len(f.read_text().splitlines()) for f in files if not f.name.startswith(".")] == [1000, 1000, 500]
    df.limit(10).write.format("tidewrack_jsonl").option("path", out).option("bytes", 100).mode("append").save()
    assert spark.read.schema("id long, text string").json(out).count() == 2510 and all(json.loads(x)["text"].startswith("text é") for f in files for x in f.read_text().splitlines())
    broken = df.select(F.when(F.col("id") == 2499, F.raise_error("torn")).otherwise(F.col("id")).alias("id"), "text")
    with pytest.raises(Exception):
        broken.write.format("tidewrack_jsonl").option("path", out).mode("append").save()
    assert spark.read.schema("id long, text string").json(out).count() == 2510
    jsonl_sink.swept(out)
    assert not list((tmp_path / "out").glob(".writing-*.jsonl"))
    df.limit(3).write.format("tidewrack_jsonl").option("path", out).mode("overwrite").save()
    assert spark.read.schema("id long, text string").json(out).count() == 3


def test_chunks_of_streams_are_written_once(spark, tmp_path):
    datasource.register(spark)
    rows = [(k, f"t{k}") for k in range(30)]
    out = f"file://{tmp_path}/lines"
    stream = batches(spark, str(tmp_path / "in"), rows, "id long, text string", 3)
    for _ in range(2):
        stream.writeStream.format("tidewrack_jsonl").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.schema("id long, text string").json(out).collect()) == list(range(30))
    assert len({f.name.split("-")[1] for f in (tmp_path / "lines").glob("batch-*.jsonl")}) == 3
