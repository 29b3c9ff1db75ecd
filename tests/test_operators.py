from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewrack.operators import alerts, catalog, crosssource, dedup, digest, entities, jobs, operations, quality, search, sentiment, sources, terms, topics

SCHEMA = "doc_id string, capture_id string, parent_doc_or_dup_group string, source_type string, url string, domain string, fetch_ts timestamp_ntz, observed_ts timestamp_ntz, title string, text string, language string, content_hash string"
DAY = datetime(2024, 6, 10, 12)


def signed(x):
    return x - 2**64 if x >> 63 else x


def make(spark, rows):
    full = []
    for k, r in enumerate(rows):
        at = r.get("at", DAY)
        full.append((r.get("doc", f"doc-{k}"), f"cap-{k:04}", r.get("group"), r.get("source", "rss"), r.get("url", f"https://example.com/{k}"), r.get("domain", "example.com"), at, at, r.get("title", f"t{k}"), r.get("text", "text"), r.get("lang"), r.get("hash")))
    return spark.createDataFrame(full, SCHEMA)


def test_series_and_spikes(spark):
    df = make(spark, [{"text": "bitcoin rises", "at": DAY - timedelta(days=d)} for d in (2, 2, 1, 0)])
    got = [(r["count"]) for r in terms.term_frequency(df, "bitcoin", 2).orderBy("bucket").collect()]
    assert got == [2, 1, 1] and sum(got) == 4
    many = make(spark, [{"text": "x", "at": DAY - timedelta(days=d)} for d in range(14)] + [{"text": "x"}] * 20)
    assert [r["count"] for r in terms.spikes(many, "x", 13).collect()] == [21]
    empty = df.limit(0)
    assert terms.term_frequency(empty, "x").count() == 0 and terms.spikes(empty, "x").count() == 0


def test_lifecycle_phases(spark):
    at = lambda d: DAY - timedelta(days=d)
    rows = [{"text": "emerge", "at": at(2)}] * 3 + [{"text": "rise", "at": at(d)} for d in (3, 2, 1, 1, 0, 0, 0)] + [{"text": "fall", "at": at(20)}] * 3 + [{"text": "rare", "at": at(9)}, {"text": "anchor", "at": at(0)}]
    got = {r.term: r.phase for r in topics.lifecycles(make(spark, rows), ["emerge", "rise", "fall", "rare", "none"], 30).collect()}
    assert got == {"emerge": "EMERGING", "rise": "EXPANDING", "fall": "DECLINING", "rare": "DORMANT", "none": "DORMANT"}


def test_sentiment(spark):
    said = ["not good", "very good", "not very good", "the cat sat on a red mat", "good bad", "not a b c good", "without a good", "", None]
    rows = sentiment.scored(spark.createDataFrame(list(enumerate(said)), "k int, text string")).orderBy("k").collect()
    assert [(r.pos, r.neg, r.score) for r in rows[:5]] == [(0.0, 1.0, -1.0), (1.5, 0.0, 1.0), (0.0, 1.5, -1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 0.0)]
    assert rows[3].tokens_scanned == 7 and rows[5].pos == 1.0 and rows[6].neg == 1.0 and rows[8].score == 0.0


def test_replication_and_origins(spark):
    rows = [{"group": "g", "domain": "a.com", "at": DAY}, {"group": "g", "domain": "b.com", "at": DAY + timedelta(minutes=30)}, {"group": "g", "domain": "b.com", "at": DAY + timedelta(hours=2)}, {"group": "h", "domain": "a.com"}, {"group": None, "domain": "c.com"}]
    df = make(spark, rows)
    edge = sources.replication_edges(df).collect()
    assert [(e.origin, e.replica, e["count"], len(e.sample_urls)) for e in edge] == [("a.com", "b.com", 1, 2)]
    story = sources.story_origins(df, "text").collect()
    assert [(s.dup_group, s.origin_domain, s.docs, s.replicas, s.lead_minutes) for s in story] == [("g", "a.com", 3, 1, 30.0)]
    with pytest.raises(LookupError):
        sources.profile_or_fail(df, "none.com", F.expr("timestamp_ntz'2024-06-11 00:00:00'"))


def test_quality_and_empty(spark):
    rows = [{"hash": "h1", "domain": "a.com"}, {"hash": "h1", "domain": "b.com"}, {"hash": "h2", "text": " ", "at": DAY - timedelta(days=2)}]
    snap = quality.quality_snapshot(make(spark, rows)).first()
    assert (snap.total_captures, snap.empty_text, round(snap.duplicate_ratio, 3), snap.near_duplicate_ratio) == (3, 1, 0.667, 0.0)
    hist = quality.quality_history(make(spark, rows), 3).orderBy("bucket").collect()
    assert [h.total for h in hist] == [1, 0, 2] and hist[2].duplicate_ratio == 1.0 and [h.new_domains for h in hist] == [1, 0, 2]
    zero = quality.quality_snapshot(make(spark, rows).limit(0)).first()
    assert zero.total_captures == 0 and zero.duplicate_ratio == 0.0


def test_catalog(spark):
    df = make(spark, [{"hash": "h", "at": DAY}, {"hash": "h", "at": DAY + timedelta(hours=1)}, {"hash": " ", "group": "g"}, {"group": "g", "at": DAY + timedelta(hours=2)}])
    assert {r.capture_id for r in catalog.folded(df, "content").collect()} == {"cap-0001", "cap-0002", "cap-0003"}
    assert {r.capture_id for r in catalog.folded(df, "group").collect()} == {"cap-0001", "cap-0003"}
    assert catalog.related_counts(df).filter("related = 1").count() == 2
    assert catalog.upserted(df.limit(1), df).count() == 3 and catalog.sampled(df, 2).count() == 2
    older = df.withColumn("fetch_ts", F.col("fetch_ts") - F.expr("interval 1 day"))
    assert catalog.latest_captures(df.union(older)).join(df, ["capture_id", "fetch_ts"]).count() == 4


def plain_murmur(raw):
    """MurmurHash3 x64 128, a block at a time."""
    m = 2**64 - 1
    rot = lambda x, r: (x << r | x >> 64 - r) & m
    c1, c2, a, b = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0, 0
    whole = len(raw) // 16 * 16
    for k in range(0, whole, 16):
        x, y = int.from_bytes(raw[k : k + 8], "little"), int.from_bytes(raw[k + 8 : k + 16], "little")
        a = ((rot(a ^ rot(x * c1 & m, 31) * c2 & m, 27) + b) * 5 + 0x52DCE729) & m
        b = ((rot(b ^ rot(y * c2 & m, 33) * c1 & m, 31) + a) * 5 + 0x38495AB5) & m
    rest = raw[whole:]
    b ^= rot(int.from_bytes(rest[8:], "little") * c2 & m, 33) * c1 & m
    a ^= rot(int.from_bytes(rest[:8], "little") * c1 & m, 31) * c2 & m
    a, b = a ^ len(raw), b ^ len(raw)
    a = a + b & m
    b = b + a & m

    def finish(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & m
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & m
        return x ^ x >> 33

    a, b = finish(a), finish(b)
    a = a + b & m
    return a, b + a & m


def test_weighted_signatures_equal_plain_ones(spark):
    import math
    import random
    from collections import Counter

    import xxhash

    rng = random.Random(5)
    texts = [None, "", "One", "two words", "Ünï-cödé, ＦＵＬＬ width! " * 3] + [" ".join("abcdefghij"[: rng.randint(1, 9)] * rng.randint(1, 4) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a b c " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in dedup.weighted_signatures(df).collect()}
    hashes = {r.doc_id: r.h for r in df.select("doc_id", dedup.content_hash_xxh3(F.col("text")).alias("h")).collect()}
    assert plain_murmur(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    for k, t in enumerate(texts):
        import re
        import unicodedata

        words = re.sub(r"[^0-9a-z\s]", " ", unicodedata.normalize("NFKC", t or "").lower()).split()
        assert hashes[k] == (None if t is None else xxhash.xxh3_64_hexdigest(" ".join(words)))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        if not grams:
            assert (got[k].hi, got[k].lo, got[k].simhash64) == (None, None, 0)
            continue
        sums, plain = [0.0] * 128, [0] * 64
        for g, n in Counter(grams).items():
            lo, hi = plain_murmur(g.encode())
            for b in range(128):
                sums[b] += (1 + math.log1p(n)) * (1 if (hi << 64 | lo) >> b & 1 else -1)
            for b in range(64):
                plain[b] += n if lo >> b & 1 else -n
        sig = sum(1 << b for b in range(128) if sums[b] >= -1e-9)
        assert ((got[k].hi, got[k].lo) == (signed(sig >> 64), signed(sig & 2**64 - 1)) or min(map(abs, sums)) < 1e-6) and got[k].simhash64 == signed(sum(1 << b for b in range(64) if plain[b] >= 0))


@pytest.mark.parametrize("part_rows", [7, 4096])
@pytest.mark.parametrize("plan", [(0, 1), (6, 4), (9, 12)])
def test_nearest_earlier_equals_brute_force_over_samples(spark, monkeypatch, part_rows, plan):
    import random

    monkeypatch.setattr(dedup, "PART_ROWS", part_rows)
    monkeypatch.setattr(dedup, "TILE_ROWS", 5)
    monkeypatch.setattr(dedup, "sampling_plan", lambda *_: plan)
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(12)]
    rows = [b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(45))) for b in base for _ in range(12)] + [0, 0, 2**128 - 1]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, signed(x >> 64), signed(x & (2**64 - 1))) for k, x in enumerate(rows)], "nid long, hi long, lo long")
    got = {r.nid: (r.d, r.other) for r in dedup.nearest_earlier(df, 32).collect()}
    masks = [(h % 2**64) << 64 | m % 2**64 for h, m in dedup.sample_masks(*plan)]
    assert len(masks) == plan[1] and all(m.bit_count() == plan[0] for m in masks)
    want = {}
    for k, x in enumerate(rows):
        near = [((x ^ y).bit_count(), j) for j, y in enumerate(rows[:k]) if (x ^ y).bit_count() <= 32 and any(not (x ^ y) & m for m in masks)]
        if near:
            want[k] = min(near)
    assert got == want and want


@pytest.mark.parametrize("rows", [10**5, 10**6, 10**8, 10**10])
def test_recall_at_the_threshold_is_kept_at_any_size(rows):
    """By formula, and by pairs at distance 32 that meet in the very samples that are used."""
    import numpy as np

    width, samples = dedup.sampling_plan(rows)
    assert dedup.expected_recall(width, samples, 32) >= 0.9 and rows / 2**width < 8192
    draw = np.random.default_rng(1)
    masks = np.array(dedup.sample_masks(width, samples), dtype=np.int64).view(np.uint64)
    differ = np.zeros((4000, 2), dtype=np.uint64)
    for p in differ:
        for k in draw.permutation(128)[:32].tolist():
            p[k // 64] |= np.uint64(1 << k % 64)
    met = ((differ[:, None, :] & masks[None, :, :]) == 0).all(axis=2).any(axis=1)
    assert met.mean() > 0.88
    assert dedup.sampling_plan(1000) == dedup.sampling_plan(rows, recall=1.0) == (0, 1)


def test_near_decisions_match_one_by_one(spark):
    import random

    random.seed(5)
    words = [f"w{k}" for k in range(60)]
    docs = []
    for _ in range(25):
        base = [random.choice(words) for _ in range(260)]
        for _ in range(random.randint(1, 3)):
            edited = list(base)
            for _ in range(random.randint(0, 6)):
                edited[random.randrange(len(edited))] = random.choice(words)
            docs.append(" ".join(edited))
    rows = [{"text": t, "hash": t, "at": DAY + timedelta(minutes=k)} for k, t in enumerate(docs)]
    got = {r.capture_id: (r.decision, r.dup_group) for r in dedup.near_decisions(make(spark, rows)).collect()}
    seen, first, root = [], {}, {}
    for k, t in enumerate(docs):
        name, doc = f"cap-{k:04}", f"doc-{k}"
        if t in first:
            assert got[name] == ("EXACT_DUP", root[first[t]])
            continue
        first[t] = doc
        hi, lo = (x % 2**64 for x in dedup.signature(t))
        toks = set(t.split())
        best = min(((((hi ^ h).bit_count() + (lo ^ l_).bit_count()), n, d, tk) for n, (d, h, l_, tk) in enumerate(seen)), default=None)
        near = best is not None and best[0] <= dedup.THRESHOLD and abs(len(toks) - len(best[3])) / max(len(toks), len(best[3])) <= 0.5 and (len(toks) > 200 or len(best[3]) > 200 or toks == best[3])
        root[doc] = root[best[2]] if near else doc
        assert got[name] == ("NEAR_DUP" if near else "NEW", root[doc])
        seen.append((doc, hi, lo, toks))
    assert dedup.calibrated_threshold(128, dedup.false_positive_rate(128, 32)) == 32 and dedup.false_positive_rate(8, 8) == 1.0


def test_search(spark, tmp_path):
    rows = [{"title": "Bitcoin price surges", "text": "bitcoin price " * 3, "url": "https://x.com/bitcoin-price"}, {"title": "Other", "text": "a long text about the price of bread " * 5}, {"title": "Bitcoin price surges", "text": "bitcoin price " * 3, "hash": None, "url": "https://x.com/2"}]
    df = make(spark, rows)
    found = search.search(df, "bitcoin price")
    assert found.mode == "fts" and [r.capture_id for r in found.rows.collect()] == ["cap-0000", "cap-0001"] and found.total == 2
    assert search.search(df, '"of bread"').mode == "phrase" and search.search(df, "zzz").total == 0 and search.search(df, "brea").mode == "substring"
    f = df.limit(1).select(*[c.alias(n) for n, c in search.rerank_factors(["bitcoin", "price"]).items()]).first()
    assert (f.title_hit, f.title_phrase, f.title_exact, f.title_prefix, f.url_exact, f.url_phrase, f.domain_nav) == (1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0)
    index = search.SearchIndex(spark, str(tmp_path / "index")).build(df.limit(2), 4).append(df)
    assert index.of_terms(["bitcoin"]).count() == 2
    said, hits = search.snippet("x " * 100 + "bitcoin price" + " y" * 200, "", ["bitcoin"])
    assert said.startswith("… ") and said[hits[0][0] : hits[0][1]] == "bitcoin"


def test_alerts(spark):
    as_of = F.expr("timestamp_ntz'2024-06-10 13:00:00'")
    df = make(spark, [{"text": "fire"}, {"text": "fire", "at": DAY - timedelta(days=3)}, {"text": "fire", "at": datetime(2024, 6, 10, 13)}])
    rules = [alerts.Rule(1, "a", "fire", "term_count", 1, 24), alerts.Rule(2, "b", "fire", "term_count", 2, 24), alerts.Rule(3, "c", "fire", "term_spike", 1, 24)]
    got = {r.rule_id: (r["count"], r.required, r.fired) for r in alerts.evaluated(df, rules, as_of).collect()}
    assert got == {1: (1, 1.0, True), 2: (1, 2.0, False), 3: (1, 1.0, True)}
    firings = spark.createDataFrame([(1, datetime(2024, 6, 10, 12, 30))], "rule_id int, fired_at timestamp_ntz")
    assert {r.rule_id for r in alerts.fired(df, rules, as_of, firings).collect()} == {3}
    assert sum(r["count"] for r in alerts.by_weekday(firings).collect()) == 1


def test_entities():
    found = entities.extract_entities("Acme Bank met Jane Doe in New York today. $btc fell; cbtcx did not.")
    assert ("BTC", "TICKER") in found and ("Acme Bank", "ORG") in found and ("Jane Doe", "PERSON") in found and ("New York", "PLACE") in found
    assert entities.extract_entities(None) == []


def test_jobs(spark):
    now = datetime(2024, 6, 10)
    rows = [("Senior Python Engineer", "Acme", "Berlin", ["python"], "email ai", "90,000", False, "ats", now, "https://a/1", 0), ("Gardener", "Green", "Paris", [], "plants", None, True, "wwr", now - timedelta(days=40), "https://a/2", 1), ("Gardener", "Green", "Paris", [], "plants", None, True, "wwr", now, "https://a/3?x", 2)]
    df = spark.createDataFrame(rows, "title string, company string, location string, tags array<string>, description string, salary string, remote boolean, source string, published_at timestamp_ntz, url string, position int")
    as_of = F.expr("timestamp_ntz'2024-06-10 00:00:00'")
    got = {r.url: r.score for r in jobs.scored(df, jobs.Profile(titles=["python engineer"], skills=["python"], min_salary=50_000), as_of).collect()}
    # phrase 25; token python: title 3 and tags 1.5; engineer: title 3; skill python: 4.5 of 4; freshness 12; trust 3.5
    assert got["https://a/1"] == 25 + 5 * 4.5 + 5 * 3 + 4 * 4.5 + 12 + 3.5 and got["https://a/2"] == 1.5 - 6.0
    assert jobs.deduped(df).count() == 2
    assert [r.url for r in jobs.ranked(df, jobs.Profile(skills=["python"]), as_of, limit=2).collect()][0] == "https://a/1"


def test_cross_and_operations(spark):
    day = lambda *c: spark.createDataFrame([(DAY.date() - timedelta(days=k), v) for k, v in enumerate(c)], "bucket date, count long")
    assert crosssource.compared(day(1, 2, 3), day(2, 4, 6)).first().r == 1.0 and crosssource.compared(day(1, 1), day(1, 2)).first().r == 0.0
    gaps = crosssource.coverage_gaps(spark.createDataFrame([("a", 1), ("b", 20)], "term string, count long"), spark.createDataFrame([("a", 30), ("b", 30), ("c", 5)], "term string, count long"))
    assert {r.term for r in gaps.filter("gap").collect()} == {"a"}
    assert crosssource.parse_lookback("2h30m") == timedelta(hours=2, minutes=30)
    assert crosssource.search_query(["a b", "c"], ["@Me"], language="en") == '("a b" OR c) from:me lang:en -is:retweet -is:reply'
    with pytest.raises(ValueError):
        crosssource.parse_lookback("soon")
    values = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "value double")
    assert values.agg(operations.percentile("value", 0.5).alias("p")).first().p == 3.0
    assert operations.prometheus([("a.b", {"x": 'q"'}, 1.0)]) == 'tidewrack_a_b{x="q\\""} 1\n'


def test_digest_and_export(spark, tmp_path):
    df = make(spark, [{"title": "Alpha beta gamma", "text": "\n\nbody", "group": "g"}, {"title": "later", "group": "g", "at": DAY + timedelta(hours=1)}])
    as_of = F.expr("timestamp_ntz'2024-06-11 00:00:00'")
    assert digest.digest_metrics(df, as_of).first().captures == 2
    assert {r.term for r in digest.title_bigrams(df, as_of).collect()} == {"alpha beta", "beta gamma"}
    rows = digest.llm_records(df).collect()
    assert [r.output for r in rows] == ["Alpha beta gamma\n\n\n\nbody"]
    digest.write_llm(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    digest.write_captures(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("fetch_day = date'2024-06-10'").count() == 2
    assert "# T" in digest.render_markdown("T", {"n": 1}, {"x": [("a", 1)]})


def test_digest_terms_count_whole_texts(spark):
    df = make(spark, [{"text": "early " * 500 + "late " * 600, "title": None}])
    as_of = F.expr("timestamp_ntz'2024-06-11 00:00:00'")
    assert [tuple(r) for r in digest.digest_terms(df, as_of).collect()] == [("late", 600), ("early", 500)]
    assert [tuple(r) for r in digest.digest_terms(df, as_of, chars=2000).collect()] == [("early", 333)]


def test_folds_of_one_large_group_and_ties(spark):
    rows = [{"text": str(k), "hash": "h", "at": DAY + timedelta(minutes=k % 7)} for k in range(200)]
    df = make(spark, rows)
    df = df.union(df.limit(3))
    best = lambda newest: sorted(((r.fetch_ts, r.capture_id) for r in df.collect()), key=lambda t: ((-1 if newest else 1) * t[0].timestamp(), t[1]))[0]
    for newest in (True, False):
        got = catalog.folded(df, "content", newest=newest).collect()
        assert [(r.fetch_ts, r.capture_id) for r in got] == [best(newest)] and got[0].asDict().keys() == set(df.columns)
    assert "Window" not in catalog.folded(df, "content")._jdf.queryExecution().optimizedPlan().toString()
    assert digest.exported(df, "none", limit=None).count() == 203
