"""Learnt language profiles, the substring index, and corpus weights against plain forms."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewrack.functions import corpusweights, langprofile
from tidewrack.functions.hashing import hashedshingles
from tidewrack.operators import dedup, substrings
from tidewrack.operators.search import substring_matches

LETTERS = {"aa": "etaoin shrdlu", "bb": "äöüß nrst ei", "cc": "жизнь вода"}


def spoken(language: str, words: int, seed: int) -> str:
    rng = random.Random(f"{language}{seed}")
    return " ".join("".join(rng.choice(LETTERS[language].replace(" ", "")) for _ in range(rng.randrange(2, 8))) for _ in range(words))


def test_runs_of_characters_equal_plain_ones():
    text = "Ab, c!  DÉ\n9é\U0001f600x"
    plain = " ab c dé é x "
    want = Counter()
    for n in (1, 2, 3):
        want.update(plain[k : k + n] for k in range(len(plain) - n + 1) if plain[k : k + n] != " ")
    got = Counter(langprofile.bins_of(text, 40).tolist())
    assert sorted(got.values()) == sorted(want.values()) and sum(got.values()) == sum(want.values())
    assert not len(langprofile.bins_of(None)) and not len(langprofile.bins_of("12 34")) and not len(langprofile.bins_of(""))


def test_languages_are_learnt_and_told(spark):
    rows = [(f"{x}{k}", spoken(x, 40, k), x) for x in LETTERS for k in range(30)] + [("n1", None, "aa"), ("n2", spoken("aa", 40, 99), None), ("n3", "", "bb"), ("n4", "1 2 3 " * 40, "cc")]
    df = spark.createDataFrame(rows, "id string, text string, language string").repartition(5)
    found = langprofile.learn(df)
    assert found.languages == ("aa", "bb", "cc")
    counts = np.full((3, 1 << langprofile.BITS), 0.5)
    for _, text, language in rows:
        if language:
            np.add.at(counts[found.languages.index(language)], langprofile.bins_of(text), 1)
    assert np.allclose(found.logs, np.log(counts / counts.sum(axis=1, keepdims=True)))
    asked = [(k, spoken(x, 60, 1000 + k), x) for k, x in enumerate(list(LETTERS) * 20)] + [(60, "kurz", None), (61, None, None), (62, "7 " * 100, None), (63, spoken("bb", 200_000, 7), "bb")]
    got = {r.k: r.x for r in spark.createDataFrame(asked, "k int, text string, want string").select("k", langprofile.detector(found)("text").alias("x")).collect()}
    assert all(got[k].language == want for k, _, want in asked)
    assert all(got[k].confidence is None for k in (60, 61, 62)) and got[63].confidence == pytest.approx(1)


def test_no_rows_teach_no_language(spark):
    empty = spark.createDataFrame([], "text string, language string")
    found = langprofile.learn(empty)
    assert found.languages == () and spark.range(1).selectExpr("repeat('word ', 50) AS text").select(langprofile.detector(found)("text").alias("x")).first().x.language is None


@pytest.mark.parametrize("share", [0.02, 1.0])
def test_substrings_by_the_index_equal_a_scan(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(substrings, "SHARE", share)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcÄß%_\\") for _ in range(rng.randrange(1, 6)))
    rows = [(f"c{k}", " ".join(word() for _ in range(2)) if k % 7 else None, " ".join(word() for _ in range(12)) if k % 5 else None) for k in range(400)] + [("c1", "again", "AGAIN \U0001f600X"), ("c-", "", "")]
    df = spark.createDataFrame(rows, "capture_id string, title string, text string").repartition(4)
    index = substrings.SubstringIndex(spark, str(tmp_path)).build(df)
    assert sorted(map(str, index.rows().drop("_id").collect())) == sorted(map(str, df.collect()))
    asked = [["abc"], ["äß"], ["aÄß"], ["%_\\"], ["b%"], ["zzz"], ["abcab", "again"], ["AIN \U0001f600x"], [], ["ab", "zzz"], ["bab", "cac"]]
    for literals, rows_at_most in ((1_000, 1_000_000), (3, 5)):
        monkeypatch.setattr(substrings, "LITERALS", literals)
        monkeypatch.setattr(substrings, "BROADCAST_ROWS", rows_at_most)
        for roots in asked:
            want = substring_matches(df, roots).collect()
            assert sorted(map(str, index.matches(roots).collect())) == sorted(map(str, want)), roots
    assert index.candidates("zzz").count() == 0 and index.candidates("ab") is None and index.candidates("again").count() == 1


def test_an_index_of_no_rows(spark, tmp_path):
    index = substrings.SubstringIndex(spark, str(tmp_path)).build(spark.createDataFrame([], "capture_id string, title string, text string"))
    assert index.matches(["abc"]).count() == 0 and index.matches(["a"]).count() == 0


def test_corpus_weights_equal_counted_ones(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) + " and this is our footer") for k in range(120)] + [(200, None), (201, ""), (202, "!!")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    normal = dedup.normalized_for_hash(df["text"])
    learnt = corpusweights.learn(df, normal)
    plain, hashed = Counter(), {}
    for _, text in rows[:120]:
        tokens = text.split()
        grams = [" ".join(tokens[k : k + 3]) for k in range(max(1, len(tokens) - 2))]
        plain.update(set(grams))
        hashed.update(zip(grams, zip(*next(hashedshingles([text])))))
    assert learnt.docs == 120 and sum(plain.values()) * corpusweights.DEPTH == learnt.counts.sum()
    h1, h2 = (np.array([hashed[g][k] for g in plain], dtype=np.uint64) for k in (0, 1))
    counted = np.array(list(plain.values()))
    assert (learnt.frequency(h1, h2) == counted).all() and plain["is our footer"] == 120
    narrow = corpusweights.learn(df, normal, bits=6)
    assert (narrow.frequency(h1, h2) >= counted).all() and narrow.counts.shape == (4, 64)
    got = {r.doc_id: (r.hi, r.lo) for r in dedup.corpus_weighted_signatures(df).collect()}
    for key, text in rows[:120]:
        tokens = text.split()
        times = Counter(" ".join(tokens[k : k + 3]) for k in range(max(1, len(tokens) - 2)))
        sums = [0.0] * 128
        for gram, n in times.items():
            weight = (1 + math.log(1 + n)) * (1 + math.log(121 / (1 + plain[gram])))
            bits = int(hashed[gram][0]) | int(hashed[gram][1]) << 64
            for b in range(128):
                sums[b] += weight if bits >> b & 1 else -weight
        want = [sum((sums[b + at] >= 0) << b for b in range(64)) for at in (64, 0)]
        assert all(abs(s) < 1e-9 or (got[key][0 if b >= 64 else 1] >> (b % 64) & 1) == (want[0 if b >= 64 else 1] >> (b % 64) & 1) for b, s in enumerate(sums))
    assert got[200] == got[201] == got[202] == (None, None)


def test_no_texts_have_no_weights(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert corpusweights.learn(empty, dedup.normalized_for_hash(empty["text"])).docs == 0 and dedup.corpus_weighted_signatures(empty).count() == 0
