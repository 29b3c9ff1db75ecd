"""Full-text search over captures: an inverted index, field-weighted ranking, re-ranking, folding, facets, snippets.

The index is postings (term, capture_id, tf_title, tf_text) written once; a query touches only the postings of its
terms, which are few, and a bounded number of candidates. The stemmer runs over the distinct vocabulary only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.functions.tokens import QUERY_TOKEN, java_escape, letter_tokens, phrase_of, query_tokens
from tidewrack.operators.catalog import first_of_each
from tidewrack.operators.terms import primary_language
from tidewrack.session import cut

MODES = ("auto", "fts", "prefix", "substring")
FIELDS = ("title", "text", "domain", "url")
K1, B_TITLE, B_TEXT, TITLE_WEIGHT = 1.2, 0.3, 0.75, 2.0
IDF_FLOOR, IDF_DOCS = 1.0, 20
MAX_RESULTS = 200

# What each re-ranking factor adds at most, and the lead and length it looks at.
BOOSTS = {"title_hit": 0.5, "title_phrase": 0.35, "title_exact": 0.4, "title_prefix": 0.25, "url_hit": 0.25, "url_phrase": 0.2, "url_exact": 0.3, "url_prefix": 0.2, "domain_nav": 0.3, "lead_hit": 0.15, "lead_phrase": 0.2, "lead_prefix": 0.2, "lead_exact": 0.25}
LEAD_CHARS, LENGTH_PIVOT, LENGTH_FLOOR, HALF_LIFE_DAYS = 280, 4000, 0.75, 30.0


# ---- index -------------------------------------------------------------------------------------------------------


def postings(df: DataFrame, stem: Callable[[DataFrame], DataFrame] | None = None, stopwords: frozenset[str] = frozenset(), only: list[str] | None = None) -> DataFrame:
    """term, capture_id, tf_title, tf_text, without stopwords, and of some terms (with stem: stems) only, where they are given. stem maps a table of distinct terms to (term, stem); it is joined to the tokens."""
    parts = [df.select("capture_id", F.lit(k).alias("f"), F.explode(letter_tokens(F.col(c))).alias("term")) for k, c in enumerate(("title", "text"))]
    rows = parts[0].union(parts[1])
    rows = rows if only is None or stem is not None else rows.filter(F.col("term").isin(only))
    rows = rows.groupBy("capture_id", "term").agg(F.count_if(F.col("f") == 0).alias("tf_title"), F.count_if(F.col("f") == 1).alias("tf_text"))
    if stopwords:
        rows = rows.filter(~F.col("term").isin(*sorted(stopwords)))
    if stem is not None:
        stems = stem(rows.select("term").distinct())
        stems = stems if only is None else stems.filter(F.col("stem").isin(only))
        rows = rows.join(stems, "term").groupBy("capture_id", F.col("stem").alias("term")).agg(F.sum("tf_title").alias("tf_title"), F.sum("tf_text").alias("tf_text"))
    return rows.select("term", "capture_id", "tf_title", "tf_text")


def field_sums(df: DataFrame) -> DataFrame:
    """One row: docs, title_chars, text_chars; rows of several tables can be added up."""
    chars = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long")
    return df.agg(F.count("*").alias("docs"), chars("title").alias("title_chars"), chars("text").alias("text_chars"))


def averaged(sums: DataFrame) -> DataFrame:
    """One row: docs, avg_title, avg_text (characters, one at least), of one or more rows of field_sums."""
    docs = F.coalesce(F.sum("docs"), F.lit(0))
    mean = lambda c: F.greatest(F.lit(1.0), F.coalesce(F.sum(c) / F.nullif(docs, F.lit(0)), F.lit(0.0)))
    return sums.agg(docs.alias("docs"), mean("title_chars").alias("avg_title"), mean("text_chars").alias("avg_text"))


def field_stats(df: DataFrame) -> DataFrame:
    return averaged(field_sums(df))


#: Captures and days of appended postings from which they are due to be merged.
PROMOTE_DOCS, PROMOTE_DAYS = 50_000, 7


@dataclass
class SearchIndex:
    """An index that is stored as Parquet: a generation of postings, with terms hashed over files so a term's are together, and a delta that is appended to.

    Readers follow the newest entry of `generations`, which is written last, so a failed build or promotion leaves the one before in place.
    """

    spark: SparkSession
    path: str

    def _generation(self):
        return self.spark.read.parquet(f"{self.path}/generations").orderBy(F.desc("number")).first()

    def _write(self, part: str, post: DataFrame, docs: DataFrame, sums: DataFrame, buckets: int) -> None:
        post.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("term").write.mode("append").partitionBy("bucket").parquet(f"{part}/postings")
        docs.write.mode("append").parquet(f"{part}/docs")
        sums.write.mode("append").parquet(f"{part}/sums")  # last: what has no sums is not counted as appended

    def _read(self, kind: str, number: int, delta: bool = True) -> DataFrame:
        parts = [f"{self.path}/{number}/base/{kind}"] + [f"{self.path}/{number}/delta/{kind}"] * (delta and self._has_delta(number))
        return self.spark.read.option("basePath", parts[0]).parquet(parts[0]) if len(parts) == 1 else self.spark.read.parquet(parts[0]).unionByName(self.spark.read.parquet(parts[1]))

    def _has_delta(self, number: int) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number}/delta/sums/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _publish(self, number: int, buckets: int) -> None:
        self.spark.createDataFrame([(number, buckets)], "number long, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def build(self, df: DataFrame, buckets: int = 64, number: int = 1, **options) -> SearchIndex:
        self._write(f"{self.path}/{number}/base", postings(df, **options), df.select("capture_id"), field_sums(df).withColumn("at", F.current_timestamp()), buckets)
        self._publish(number, buckets)
        return self

    def append(self, df: DataFrame, at: Column | None = None, **options) -> SearchIndex:
        """Adds captures that the index has not, in the delta; document frequencies and averages are over all of it."""
        now = self._generation()
        fresh = df.join(self._read("docs", now.number), "capture_id", "left_anti")
        self._write(f"{self.path}/{now.number}/delta", postings(fresh, **options), fresh.select("capture_id"), field_sums(fresh).withColumn("at", F.current_timestamp() if at is None else at.cast("timestamp")), now.buckets)
        return self

    def due(self, as_of: Column) -> bool:
        """Whether the delta is large or old enough to be merged."""
        number = self._generation().number
        if not self._has_delta(number):
            return False
        row = self.spark.read.parquet(f"{self.path}/{number}/delta/sums").agg(F.sum("docs").alias("docs"), (F.min("at") <= as_of.cast("timestamp") - F.expr(f"interval {PROMOTE_DAYS} days")).alias("old")).first()
        return (row.docs or 0) >= PROMOTE_DOCS or bool(row.old)

    def promote(self) -> SearchIndex:
        """A new generation of base and delta together. The one before stays, for readers that have begun."""
        now = self._generation()
        sums = self._read("sums", now.number).agg(*[F.sum(c).alias(c) for c in ("docs", "title_chars", "text_chars")], F.max("at").alias("at"))
        self._write(f"{self.path}/{now.number + 1}/base", self._read("postings", now.number).drop("bucket"), self._read("docs", now.number), sums, now.buckets)
        self._publish(now.number + 1, now.buckets)
        return self

    def missing(self, df: DataFrame) -> DataFrame:
        """The captures of df that the index has not: none if it is fresh."""
        return df.join(self._read("docs", self._generation().number), "capture_id", "left_anti")

    def stats(self) -> DataFrame:
        return averaged(self._read("sums", self._generation().number))

    def of_terms(self, terms: list[str]) -> DataFrame:
        now = self._generation()
        hashed = self.spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(now.buckets)).alias("b")).collect()
        return self._read("postings", now.number).filter(F.col("bucket").isin([r.b for r in hashed]) & F.col("term").isin(terms)).drop("bucket")


# ---- ranking -----------------------------------------------------------------------------------------------------


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def bm25f(df: DataFrame, terms: list[str], post: DataFrame | None = None, prune: bool = False, stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """capture_id, score: field-weighted BM25 over distinct query terms; lengths in characters.

    With prune, terms of little information are left out where the corpus has twenty documents or more, never all. With stem, terms are stems.
    """
    terms = list(dict.fromkeys(terms))
    post = postings(df, stem, only=terms) if post is None else post.filter(F.col("term").isin(terms))
    stats = field_stats(df)
    freq = document_frequencies(post).join(F.broadcast(stats)).withColumn("idf", idf(F.col("docs"), F.col("df")))
    if prune:
        keep = (F.col("idf") >= IDF_FLOOR) | (F.col("docs") < IDF_DOCS)
        freq = freq.withColumn("any", F.max(keep.cast("int")).over(Window.partitionBy(F.lit(0)))).filter(keep | (F.col("any") == 0)).drop("any")
    lengths = df.select("capture_id", F.length(F.coalesce("title", F.lit(""))).alias("len_t"), F.length(F.coalesce("text", F.lit(""))).alias("len_x"))
    rows = post.join(F.broadcast(freq), "term").join(lengths, "capture_id")  # at most one row a query term
    norm = lambda b, n, avg: F.greatest(F.lit(1e-4), 1 + b * (F.col(n) / F.col(avg) - 1))
    tf = TITLE_WEIGHT * F.col("tf_title") / norm(B_TITLE, "len_t", "avg_title") + F.col("tf_text") / norm(B_TEXT, "len_x", "avg_text")
    return rows.groupBy("capture_id").agg(F.round(F.sum(F.col("idf") * tf / (K1 + tf)), 9).alias("score"))


def dropped_terms(df: DataFrame, terms: list[str], post: DataFrame) -> DataFrame:
    """term, df, idf, dropped: what pruning leaves out."""
    freq = document_frequencies(post.filter(F.col("term").isin(terms))).join(F.broadcast(field_stats(df))).withColumn("idf", idf(F.col("docs"), F.col("df")))
    low = (F.col("idf") < IDF_FLOOR) & (F.col("docs") >= IDF_DOCS)
    every = F.min(low.cast("int")).over(Window.partitionBy(F.lit(0)))
    return freq.select("term", "df", F.round("idf", 6).alias("idf"), (low & (every == 0)).alias("dropped"))


def substring_matches(df: DataFrame, roots: list[str], fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """Rows in which any field has any root, whatever the case."""
    found = F.lit(False)
    for c in clean_fields(fields):
        for r in roots:
            like = "%" + re.sub(r"([%_\\])", r"\\\1", r) + "%"
            found = found | F.coalesce(F.col(c).ilike(like), F.lit(False))
    return df.filter(found)


def clean_fields(fields) -> list[str]:
    return list(dict.fromkeys(f for f in (fields or ()) if f in FIELDS)) or ["title", "text"]


def phrase_matches(df: DataFrame, phrase: str) -> DataFrame:
    return substring_matches(df, [phrase])


# ---- re-ranking ----------------------------------------------------------------------------------------------------


def _tokens(text: Column, least: int = 2) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9']+"), F.lit(0)), lambda t: F.length(t) >= least)


def _hit(text: Column, terms: list[str]) -> Column:
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0)) / F.lit(len(terms))


def _phrase(text: Column, terms: list[str]) -> Column:
    if len(terms) < 2:
        return F.lit(0.0)
    gaps = "(?s)" + ".*?".join(java_escape(t) for t in terms)
    return F.when(F.contains(text, F.lit(" ".join(terms))), 1.0).when(text.rlike(gaps), 0.5).otherwise(0.0)


def _exact(tokens: Column, wanted: Column) -> Column:
    return (tokens == wanted).cast("double")


def _prefix(tokens: Column, wanted: Column, n: int) -> Column:
    return (F.slice(tokens, 1, n) == wanted).cast("double")


def rerank_factors(terms: list[str]) -> dict[str, Column]:
    """Each factor's fraction, 0 to 1, over columns title, text, url and domain."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    wanted, n = F.array(*[F.lit(t) for t in terms]), len(terms)
    title, lead = low("title"), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, LEAD_CHARS))
    where = F.concat_ws(" ", low("domain"), low("url"))
    blob = F.trim(F.regexp_replace(where, "[^a-z0-9']+", " "))
    leaf = F.regexp_extract(F.regexp_replace(low("url"), r"^[a-z][a-z0-9+.-]*://[^/?#]*|[?#].*$", ""), r"([^/]+)/*$", 1)
    slug = _tokens(F.regexp_replace(leaf, r"(?<=.)\.(html|htm|php|aspx)$", ""))
    labels = F.regexp_extract_all(low("domain"), F.lit("[a-z0-9]+"), F.lit(0))
    title_t, lead_t = _tokens(title), _tokens(lead)
    nav = F.size(F.filter(wanted, lambda t: F.array_contains(labels, t))) / F.lit(n)
    return {
        "title_hit": _hit(title, terms),
        "title_phrase": _phrase(title, terms),
        "title_exact": _exact(title_t, wanted),
        "title_prefix": _prefix(title_t, wanted, n),
        "url_hit": _hit(where, terms),
        "url_phrase": _phrase(blob, terms),
        "url_exact": _exact(slug, wanted),
        "url_prefix": _prefix(slug, wanted, n),
        "domain_nav": nav,
        "lead_hit": _hit(lead, terms),
        "lead_phrase": _phrase(lead, terms),
        "lead_prefix": _prefix(lead_t, wanted, n),
        "lead_exact": _exact(lead_t, wanted),
    }


def length_factor(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n <= LENGTH_PIVOT, 1.0).otherwise(LENGTH_FLOOR + (1 - LENGTH_FLOOR) * LENGTH_PIVOT / n)


def recency_factor(time: Column, newest: Column, weight: float = 0.0) -> Column:
    days = (F.unix_seconds(newest.cast("timestamp")) - F.unix_seconds(time.cast("timestamp"))) / 86400
    return F.coalesce(1 + weight * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS), F.lit(1.0))


def reranked(candidates: DataFrame, terms: list[str], recency: float = 0.0) -> DataFrame:
    """Adds final_score: the score over the best score, times one factor for each sign of a match in title, address or lead."""
    best = F.max("score").over(Window.partitionBy(F.lit(0)))  # candidates are a bounded page
    final = F.when(best > 0, F.col("score") / best).otherwise(0.0)
    for name, fraction in rerank_factors(terms).items():
        final = final * (1 + BOOSTS[name] * fraction)
    final = final * length_factor(F.col("text"))
    if recency:
        final = final * recency_factor(F.col("fetch_ts"), F.max("fetch_ts").over(Window.partitionBy(F.lit(0))), recency)
    return candidates.withColumn("final_score", F.round(final, 9))


def collapse_key() -> Column:
    """By group, else by hash, else by title and domain."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    t = F.concat(F.lit("t:"), F.lower(F.trim(F.coalesce("title", F.lit("")))), F.lit("|"), F.lower(F.trim(F.coalesce("domain", F.lit("")))))
    return F.coalesce(F.concat(F.lit("p:"), blank("parent_doc_or_dup_group")), F.concat(F.lit("h:"), blank("content_hash")), t)


def collapsed(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of each key, by the given order (compared ascending) and capture_id."""
    return first_of_each(rows, collapse_key(), *order)


def newest_first() -> tuple[Column, Column]:
    """An order for collapsed: newest rows first, those without a time last."""
    return F.col("fetch_ts").isNull(), -F.unix_micros(F.col("fetch_ts").cast("timestamp"))


def facets(matches: DataFrame, limit: int = 10) -> DataFrame:
    """facet, value, count: the most frequent domains, source types and primary languages of a match set, blanks left out."""
    w = Window.partitionBy("facet").orderBy(F.desc("count"), "value")
    values = F.explode(F.array(F.struct(F.lit("domain").alias("facet"), F.lower(F.trim("domain")).alias("value")), F.struct(F.lit("source").alias("facet"), F.lower(F.trim("source_type")).alias("value")), F.struct(F.lit("language").alias("facet"), primary_language().alias("value"))))
    rows = matches.select(values.alias("v")).select("v.*").filter("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count("*").alias("count"))
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit).drop("__n")


def snippet(text: str, title: str | None, terms: list[str], stem: Callable[[str], str] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """About 220 characters around the first term, widened to whole words, and the places of terms in them. With stem, terms are stems, and all words of theirs count."""
    text = text or title or ""
    if not text or not terms:
        return text[:200].strip(), []
    words = re.compile(r"\b(?:%s)\b" % "|".join(map(re.escape, terms)), re.IGNORECASE)
    known: dict[str, bool] = {}

    def hits(said: str) -> Iterator[re.Match]:
        if stem is None:
            yield from words.finditer(said)
            return
        for m in QUERY_TOKEN.finditer(said):
            word = m[0].lower()
            if word not in known:
                known[word] = stem(word) in terms
            if known[word]:
                yield m

    first = next(hits(text), None)
    if first:
        a, b = first.span()
        a, b = a - 80, b + 140
    else:
        places = [p for p in (text.lower().find(t) for t in terms) if p >= 0]
        if not places:
            return text[:200].strip(), []
        a, b = min(places) - 80, min(places) + 140
    a, b = max(0, a), min(len(text), b)
    while a and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    said = ("… " if a else "") + text[a:b].strip() + (" …" if b < len(text) else "")
    return said, [m.span() for m in hits(said)]


def with_snippets(page: DataFrame, terms: list[str], stem: Callable[[str], str] | None = None) -> DataFrame:
    @F.arrow_udf("struct<snippet:string,hits:array<array<int>>>")
    def cut(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, titles in rows:
            got = [snippet(x, t, terms, stem) for x, t in zip(texts.to_pylist(), titles.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([[list(h) for h in g[1]] for g in got], pa.list_(pa.list_(pa.int32())))], ["snippet", "hits"])

    return page.withColumn("__s", cut("text", "title")).select(*page.columns, "__s.snippet", "__s.hits")


@dataclass
class SearchResult:
    mode: str
    total: int
    rows: DataFrame
    facets: DataFrame
    hints: list[str] = field(default_factory=list)


def search(df: DataFrame, query: str, mode: str = "auto", limit: int = 30, offset: int = 0, max_results: int = MAX_RESULTS, fields: tuple[str, ...] = ("title", "text"), index: SearchIndex | None = None, prune: bool = True, unique: bool = True, stemmer: ModuleType | None = None) -> SearchResult:
    """A page of results. Ranked search first; if it finds nothing, substrings; a query in quotes is a phrase.

    stemmer has `stem` of a word and `stems` of a table (functions.stemmer): ranked search then finds every form of a word, and an index must be
    built with its `stems`. Re-ranking looks at the words as they were asked. total counts all that is found. A page is a top-k report: the `max_results` best (200 at least) by score are re-ranked.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    phrase, terms = phrase_of(query), query_tokens(query)
    ranked, used = None, mode
    newest = (F.col("fetch_ts").desc_nulls_last(), F.col("capture_id").asc())
    if phrase:
        used, found = "phrase", phrase_matches(df, phrase)
    elif mode in ("prefix", "substring"):
        found = substring_matches(df, terms, fields)
    elif not terms:
        found = df.limit(0)
    else:
        used = "fts"
        roots = [stemmer.stem(t) for t in terms] if stemmer else terms
        scores = bm25f(df, roots, index.of_terms(roots) if index else None, prune, stemmer and stemmer.stems)
        scores = cut(scores) if stemmer and not index else scores  # rows, total and facets need them; the vocabulary is stemmed once
        found = ranked = df.join(scores, "capture_id")
        if mode == "auto" and found.isEmpty():
            used, ranked, found = "substring", None, substring_matches(df, terms, fields)
    if ranked is not None:
        window = max(200, max_results)
        top = reranked(ranked.orderBy(F.desc("score"), "capture_id").limit(window), terms)
        order = (F.col("final_score").desc(), F.col("score").desc(), F.col("capture_id").asc())
        page = collapsed(top, -F.col("final_score"), -F.col("score")) if unique else top
    else:
        page, order = (collapsed(found, *newest_first()) if unique else found), newest
    total = found.count() if not unique else found.select(F.count_distinct(collapse_key())).first()[0]
    rows = page.orderBy(*order).limit(max_results).offset(max(0, offset)).limit(max(1, min(limit, MAX_RESULTS)))
    hints = [] if total else ["no document matches" + ("; try mode substring" if used == "fts" else "")]
    said = with_snippets(rows, [phrase] if phrase else terms) if ranked is None or not stemmer else with_snippets(rows, roots, stemmer.stem)
    return SearchResult(used, total, said, facets(found), hints)
