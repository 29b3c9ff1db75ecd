"""Spelling variants, exact top-k search and fill-in-the-middle against brute force, and on odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewrack.llm import bpe, classifier, host_rules, infill, mixing, packing, rlindex, secrets, simhash, spotsigs, topk, variants, warc

TEXT = "doc_id long, text string"
rng = random.Random(5)
ODD = [None, "", " \n\t", "word", "Straße été", "aaaa " * 500, "日本語 テキスト", "x" * 3000, "a <S> b", "naïve 🙂 🙂🙂 fin ", "\n lead and tail \t"]


def odd_docs(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "word"), (3, "word"), (None, "no id here"), (None, None)]
    clash = {c: F.lit(1) for c in ("row", "word", "n", "form", "a", "b", "of", "ordinal", "upto", "meta.url")}
    return rows, spark.createDataFrame(rows, TEXT).withColumns(clash)


# ---- 11 --------------------------------------------------------------------------------------------------------------


def plain_variants(rows, min_chars=5, min_count=3, every=97):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            counts[w if h % every else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(links[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(links[w]), words[form[w]] if form[w] else None)
    return out


def typed(letters, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(n)]
    return [" ".join(rng.choice(words) if rng.random() < 0.8 else rng.choice(words)[:-1] + rng.choice(letters) for _ in range(300)) for _ in range(40)]


@pytest.mark.parametrize("letters", ["ab", "abcdéÀ", "aaaab"])
def test_variants_equal_brute_force(spark, letters):
    rows = list(enumerate(typed(letters, 60)))
    docs = spark.createDataFrame(rows, TEXT)
    want = plain_variants(rows)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(docs).collect()} == want and any(v[0] for v in want.values())
    # postings and readers in parts, and a table of counts that is far too small, change nothing
    words = spark.createDataFrame([(w, v[2]) for w, v in want.items()], "word string, n long")
    for gram, bits, part in ((4, 4, 3), (2, 12, 5), (3, 16, 2048)):
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variant_groups(words, gram=gram, bits=bits, part_words=part).collect()}
        assert got == want


def test_count_filter_loses_no_edit():
    for gram in (2, 3, 4):
        for _ in range(300):
            a = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 9)))
            k, c = rng.randrange(len(a) + 1), rng.choice("abc")
            longer = a[:k] + c + a[k:]
            assert variants.shared_grams(variants._codes([a], len(a)), variants._codes([longer], len(longer)), gram)[0] >= len(longer) - 1
            other = a[: k - 1] + c + a[k:] if k else a
            assert variants.shared_grams(variants._codes([a], len(a)), variants._codes([other], len(a)), gram)[0] >= len(a) - 1
            assert variants.one_edit(a, longer) and variants.one_edit(longer, a) and variants.one_edit(a, other) == (a != other)
    assert not variants.one_edit("ab", "ab") and not variants.one_edit("ab", "ba") and not variants.one_edit("ab", "abcd")
    posting = [(1, "abcd", 3), (4, "abce", 2)]
    assert list(variants.merged("abc", [posting, posting[1:], [(2, "zzz", 1)]])) == posting


def test_variants_of_odd_rows(spark):
    rows, docs = odd_docs(spark)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(docs, min_chars=2, min_count=1).collect()}
    assert got == plain_variants(rows, 2, 1)
    assert variants.spelling_variants(spark.createDataFrame([], TEXT)).count() == 0
    long = [(1, "b" * 100_000 + " " + "b" * 100_001 + " " + "b" * 99_999 + "c")] * 3
    got = {len(r.word): (r.n, r.n_near) for r in variants.spelling_variants(spark.createDataFrame(long, TEXT), drop_every=0).collect() if "c" not in r.word}
    assert got == {100_000: (3, 2), 100_001: (3, 1)}
    with pytest.raises(ValueError):
        variants.near_words(spark.createDataFrame([("a", 1)], "word string, n long"))


# ---- 12 --------------------------------------------------------------------------------------------------------------

VECTOR = "vec_id long, embedding array<float>"


def plain_top(rows, k=5, every=50):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for p, (i, q) in enumerate(fine):
        if i is not None and i % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for o, (j, v) in enumerate(fine) if o != p))[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scores, 1)]
    return Counter(out)


def top_rows(df):
    return Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("kind", ["normal", "clusters", "ties", "positive", "sparse"])
def test_top_products_equal_brute_force(spark, kind):
    n, d = 900, 12
    g = np.random.default_rng(3)
    x = g.normal(size=(n, d)) * 0.2
    if kind == "clusters":
        x = np.repeat(g.normal(size=(9, d)), 100, axis=0) + 0.02 * x
    elif kind == "ties":
        x = g.integers(-1, 2, size=(n, d)) / 256
    elif kind == "positive":
        x = np.abs(x)
    elif kind == "sparse":
        x = x * (g.random((n, d)) < 0.2)
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(g.permutation(n) if kind != "ties" else np.arange(n) // 2, x)]
    df = spark.createDataFrame(rows, VECTOR)
    want = plain_top(rows)
    assert top_rows(topk.top_products(df)) == want
    assert top_rows(topk.top_products(df, block_rows=70, query_rows=7)) == want


def test_lists_stop_early_and_bounds_hold():
    g = np.random.default_rng(4)
    x = np.floor(256 * (np.repeat(g.normal(size=(20, 16)), 50, axis=0) + 0.05 * g.normal(size=(1000, 16))))
    q = x[::50]
    read = []

    class Watched(topk.BlockLists):
        def read(self, a, b, low, high):
            read.append(b)
            super().read(a, b, low, high)

    found = topk.block_best(Watched(x), q, np.arange(0, 1000, 50), np.full(len(q), -np.inf))
    assert max(read) < 1000  # no list is read to its end
    for i, (rows, scores) in enumerate(found):
        every = x @ q[i]
        assert (scores == every[rows]).all() and 50 * i not in rows
        every[50 * i] = -np.inf
        assert set(np.flatnonzero(every >= np.sort(every)[-5])) <= set(rows.tolist()) and len(rows) < 100


def test_top_products_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (150, [None, 1.0]), (200, [float("inf"), 0.0]), (250, []), (300, [-1.0]), (None, [3.0, 1.0]), (None, [3.0, 1.0]), (7, [0.5, 0.5, 9.0])]
    df = spark.createDataFrame(rows, VECTOR).withColumns({c: F.lit(1) for c in ("row", "score", "rank", "block", "group", "v", "floor", "meta.url")})
    assert top_rows(topk.top_products(df)) == plain_top(rows)
    assert topk.top_products(spark.createDataFrame([], VECTOR)).count() == 0
    assert topk.top_products(spark.createDataFrame([(50, [1.0])], VECTOR)).count() == 0
    huge = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [-3e9, 1.0]), (3, [3e9, 2.0]), (4, [3e9, 1.0000001])]
    got = topk.top_products(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), k=3).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (3, 2**63 - 1), (4, 2**63 - 1)]


# ---- 13 --------------------------------------------------------------------------------------------------------------


def plain_infill(i, t):
    t = t or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, sha(t), sha(t))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (i, n, form, len(prefix), len(middle), sha(out), sha(t))


def test_infill_equals_brute_force(spark):
    odd, docs = odd_docs(spark)
    rows = odd + [(k, "".join(rng.choice(["ab", "é", " ", "\n", "<", ">", "S", "P>", "<M", "🙂", " "]) for _ in range(rng.randrange(60)))) for k in range(100, 400)]
    docs = spark.createDataFrame(rows, TEXT).withColumns({c: F.lit(1) for c in ("row", "n", "form", "a", "b", "of", "ordinal", "upto", "output", "meta.url")})
    got = Counter(tuple(r) for r in infill.digests(infill.infilled(docs)).collect())
    assert got == Counter(plain_infill(*r) for r in rows) and {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert infill.infilled(spark.createDataFrame([], TEXT)).count() == 0


def test_infill_of_a_very_long_text(spark):
    rows = [(k, "word and é " * 200_000 if k % 2 else " " * 3_000_000 + "x") for k in range(6)]
    got = sorted(tuple(r) for r in infill.digests(infill.infilled(spark.createDataFrame(rows, TEXT))).collect())
    assert got == sorted(plain_infill(*r) for r in rows) and any(r[2] != "plain" for r in got)


def test_infill_shuffles_once(spark):
    docs = spark.createDataFrame([(k, "one two three") for k in range(50)], TEXT)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = infill.infilled(docs)
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert plan.count("REPARTITION_BY_NUM") == 3 and plan.count("ReusedExchange") == 2 and "ENSURE_REQUIREMENTS" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and plan.count("SortMergeJoin") == 2


# ---- earlier operators on hostile rows --------------------------------------------------------------------------------


def test_dotted_names_and_hostile_columns(spark):
    rows = [(k, f"text number {k} " + "word " * k, "s", 5, "u", "v") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, `meta.url` string, `a``b` string")
    for made in (simhash.keep_one_of_each(docs), mixing.mix(docs), secrets.redact(docs)):
        assert made.columns == docs.columns and {r["meta.url"] for r in made.collect()} == {"u"}


def test_secrets_of_dense_texts_take_time_in_proportion():
    def seconds(n):
        draw = random.Random(1)
        text = "-".join("".join(draw.choice("ABCDEFGHJKLMNPQRSTUVWXYZghjkmnpqrstuvwxyz23456789") for _ in range(24)) + "".join(draw.choice("0123456789abcdef") for _ in range(20)) for _ in range(n))
        encoding = secrets.vocabulary(secrets.default_path())
        began = time.process_time()
        secrets.scan(text, encoding)
        return time.process_time() - began

    seconds(50)
    assert seconds(4000) < 16 * max(0.02, seconds(500))


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"copy {k}") for k in range(10_000)] + [(k, "x" * 100) for k in range(2, 40)], TEXT)
    labels = spark.createDataFrame([(k, 1) for k in range(1, 40)], "doc_id long, quality int")
    every = classifier.training_sample(docs, labels).collect()
    assert len(every) == len({r.doc_id for r in every}) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 40))
    few = classifier.training_sample(docs, labels, chars=1000).collect()
    assert 9 <= len(few) <= 11 and sum(len(r.text) for r in few) <= 1000
    assert classifier.training_sample(docs, labels, chars=1).count() == 1


def test_texts_of_millions_of_characters(spark):
    """Every operator on one text of five million characters beside short ones."""
    huge = ("the stone of the river and glass in field " * 120_000)[:5_000_000]
    rows = [(0, huge, "a"), (1, "short text of the stone", "b"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert {r.doc_id: r.n_chars for r in spotsigs.fingerprinted(docs).collect()}[0] == 5_000_000
    assert simhash.simhash_components(docs).count() == 3
    encoded = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = library.encode(huge, add_special_tokens=False).ids
    assert encoded[0].n_tokens == len(ids) and encoded[0].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    archived = {r.page_id: r for r in warc.archived(docs.selectExpr("doc_id AS page_id", "cast(doc_id as string) AS url", "text AS html")).collect()}
    assert archived[0].payload_bytes == 5_000_000
    assert {r.doc_id: r.n_words for r in host_rules.host_filtered(docs).collect()}[0] == len(huge.split())
    removed = {r.doc_id: r.n_removed for r in rlindex.repeats_removed(docs).collect()}
    assert removed[0] == 5_000_000 and removed[1] == 0
    assert {r.doc_id: r.spans for r in secrets.secret_scan(docs).collect()}[0] == ""
    assert {r.doc_id: r["size"] for r in mixing.mixed(docs).collect()}[0] == len(huge.split())
    assert packing.packed(docs).count() >= 1
    assert classifier.classify(docs, labels).count() == 3
    assert infill.infilled(docs).count() == 3 and variants.spelling_variants(docs).count() == 4
