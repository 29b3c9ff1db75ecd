"""Search by stems, exact ranks of large groups, and listings in turns, against plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from tidewrack.functions import stemmer
from tidewrack.operators import jobs, operations, search


def captures_of(spark, texts):
    rows = [(f"c{k}", title, text, f"h{k}", None, "https://e.example/%d" % k, "e.example", "web", "en", None) for k, (title, text) in enumerate(texts)]
    return spark.createDataFrame(rows, "capture_id string, title string, text string, content_hash string, parent_doc_or_dup_group string, url string, domain string, source_type string, language string, fetch_ts timestamp_ntz")


TEXTS = [("Banks", "the bank lends to banks"), ("River", "banking on the river"), ("Rivers", "all rivers run"), (None, "nothing of it"), ("", None), ("Lending", "they were lending, she lends")]


def test_every_form_of_a_word_is_found_and_marked(spark):
    df = captures_of(spark, TEXTS)
    got = search.search(df, "banks", prune=False, stemmer=stemmer)
    rows = {r.capture_id: r for r in got.rows.collect()}
    assert got.mode == "fts" and got.total == 2 and set(rows) == {"c0", "c1"}
    assert [rows["c0"].snippet[a:b] for a, b in rows["c0"].hits] == ["bank", "banks"] and [rows["c1"].snippet[a:b] for a, b in rows["c1"].hits] == ["banking"]
    assert {r.capture_id for r in search.search(df, "banks", mode="fts", prune=False).rows.collect()} == {"c0"}
    assert search.search(df, "zzz", mode="fts", prune=False, stemmer=stemmer).total == 0


def test_stemmed_scores_and_index(spark, tmp_path):
    df = captures_of(spark, TEXTS)
    index = search.SearchIndex(spark, f"file://{tmp_path}/index").build(df, buckets=2, stem=stemmer.stems)
    roots = [stemmer.stem(w) for w in ("rivers", "lending")]
    got = {r.capture_id: r.score for r in search.bm25f(df, roots, stem=stemmer.stems).collect()}
    assert got == {r.capture_id: r.score for r in search.bm25f(df, roots, index.of_terms(roots)).collect()}

    words = [[[stemmer.stem(w) for w in re.findall(r"[a-z0-9']+", (x or "").lower())] for x in pair] for pair in TEXTS]
    averages = [max(1, sum(len(pair[k] or "") for pair in TEXTS) / len(TEXTS)) for k in (0, 1)]
    want = {}
    for root in roots:
        df_ = sum(root in t + x for t, x in words)
        for k, (t, x) in enumerate(words):
            if root in t + x:
                norm = [max(1e-4, 1 + b * (len(TEXTS[k][f] or "") / averages[f] - 1)) for f, b in ((0, search.B_TITLE), (1, search.B_TEXT))]
                tf = search.TITLE_WEIGHT * t.count(root) / norm[0] + x.count(root) / norm[1]
                want[f"c{k}"] = want.get(f"c{k}", 0) + math.log(1 + (len(TEXTS) - df_ + 0.5) / (df_ + 0.5)) * tf / (search.K1 + tf)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_percentiles_of_hot_groups(spark):
    rnd = random.Random(3)
    groups = {"hot": [rnd.gauss(0, 1) for _ in range(20_000)], "ties": [float(rnd.randint(0, 3)) for _ in range(5_000)], "one": [7.0], "two": [1.0, 2.0], "none": [None, None], "some": [None, 3.0, 1.0], None: [5.0, 4.0, 6.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "name string, value double")
    shares = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r["name"]: r for r in operations.percentiles(df, shares).collect()}
    assert set(got) == set(groups)
    for name, values in groups.items():
        there = sorted(v for v in values if v is not None)
        for c, share in shares.items():
            assert got[name][c] == (there[round(share * (len(there) - 1))] if there else None), (name, c)
    assert operations.percentiles(df.limit(0), shares).count() == 0
    lists = {r["name"]: r.p for r in df.groupBy("name").agg(operations.percentile("value", 0.95).alias("p")).collect()}
    assert lists == {k: r["p95"] for k, r in got.items()}


def test_listings_in_turns_lose_none_by_the_bound(spark):
    rnd = random.Random(4)
    for sizes, limit in (({"linkedin": 50, "ats": 3, "x": 1}, 10), ({"linkedin": 40}, 12), ({"ats": 30, "b": 30, "c": 2}, 20), ({"linkedin": 2, "ats": 2}, 40)):
        rows = [(s, round(rnd.random(), 3), k) for s, n in sizes.items() for k in range(n)]
        df = spark.createDataFrame(rows, "source string, score double, position int")
        slots, keyed = max(1, round(limit * jobs.RESERVE)), []
        for s in sizes:
            for p, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (-r[1], r[2])), 1):
                held = s == "linkedin" and p <= slots
                keyed.append(((0 if held else p - slots if s == "linkedin" else p, p if held else 0, 0 if s == "linkedin" else 1 if s == "ats" else 2, s), r))
        want = [r for _, r in sorted(keyed)][:limit]
        assert [tuple(r) for r in jobs.diversified(df, [F.desc("score"), F.col("position")], limit).collect()] == want
