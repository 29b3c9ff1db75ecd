"""The queries over the driver's tables, each with the SQL that DuckDB must agree with, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import html, lexicon, urls
from tidewrack.functions import text as texts
from tidewrack.functions.tokens import ANALYTICS_STOPWORDS, DIGEST_STOPWORDS, SOURCE_STOPWORDS, re2_pattern, sql_words
from tidewrack.operators import alerts, catalog, crosssource, dedup, digest, entities, jobs, operations, quality, search, sentiment, sources, terms, topics
from tidewrack.sources.testdata import CAPTURES_SQL, captures, table
from tidewrack.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-28 12:00:00"
TERM, OTHER = "the", "that"
TOPICS = ["the", "der", "les", "que"]
SEARCH = ["thereat", "onation", "the"]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def as_of():
    return F.expr(f"timestamp_ntz'{AS_OF}'")


#: Queries that look at duplicate groups; the others are spared the join that makes them.
GROUPED = set(
    """lead_times source_impact replication_map top_replicators domain_rank story_origins publisher_firsts quality_snapshot
    quality_history captures_unique_group related_counts related_captures collapsed_search search_page llm_export""".split()
)


def over_captures(name: str, sql: str | None = None) -> Callable:
    """Registers a function of captures, and SQL that may use captures."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        _queries[name] = lambda spark, sf_dir: f(captures(spark, sf_dir, name in GROUPED))
        if sql:
            _oracles[name] = f"WITH {CAPTURES_SQL}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
        return f

    return add


def over_tables(name: str, sql: str | None = None) -> Callable:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return add


def _tail(days: int, column: str = "fetch_ts") -> str:
    return f"{column} >= (SELECT max({column}) FROM captures) - INTERVAL {days} DAY AND {column} <= (SELECT max({column}) FROM captures)"


def _has(term: str) -> str:
    p = re2_pattern(term)
    return f"(regexp_matches(coalesce(title, ''), '{p}') OR regexp_matches(coalesce(text, ''), '{p}'))"


def _calendar(days: int, granularity: str = "day") -> str:
    step = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH"}[granularity]
    return f"""calendar AS (
  SELECT CAST(unnest(generate_series(date_trunc('{granularity}', lo), date_trunc('{granularity}', hi), INTERVAL {step})) AS DATE) AS bucket
  FROM (SELECT max(fetch_ts) - INTERVAL {days} DAY AS lo, max(fetch_ts) AS hi FROM captures))"""


def _series(term: str, days: int, granularity: str = "day") -> str:
    return f""", {_calendar(days, granularity)},
counts AS (SELECT CAST(date_trunc('{granularity}', fetch_ts) AS DATE) AS bucket, count(*) AS n FROM captures WHERE {_has(term)} AND {_tail(days)} GROUP BY 1),
series AS (SELECT c.bucket, CAST(coalesce(n, 0) AS BIGINT) AS count FROM calendar c LEFT JOIN counts USING (bucket))"""


def _words(column: str, least: int, stopwords: frozenset[str], where: str = "true", extra: str = "") -> str:
    return f"""words AS (
  SELECT * FROM (SELECT unnest(regexp_extract_all(lower({column}), '[a-z0-9]+')) AS term{extra} FROM captures WHERE {where})
  WHERE length(term) >= {least} AND term NOT IN ({sql_words(stopwords)}))"""


# ---- terms -----------------------------------------------------------------------------------------------------------

_TOP = "SELECT term, count(*) AS count FROM words GROUP BY term HAVING count(*) >= 2 ORDER BY count DESC, term LIMIT 50"

for _g, _days in (("day", 14), ("week", 28), ("month", 30)):
    over_captures(f"term_frequency_{_g}", f"{_series(TERM, _days, _g)} SELECT bucket, count FROM series")(lambda df, g=_g, d=_days: terms.term_frequency(df, TERM, d, g))

over_captures("terms_frequency", f", {_calendar(14)}, counts AS (SELECT CAST(fetch_ts AS DATE) AS bucket, " + ", ".join(f"count(*) FILTER (WHERE {_has(t)}) AS n{k}" for k, t in enumerate(TOPICS)) + f" FROM captures WHERE {_tail(14)} GROUP BY 1), joined AS (SELECT c.bucket, counts.* EXCLUDE (bucket) FROM calendar c LEFT JOIN counts USING (bucket)) " + " UNION ALL ".join(f"SELECT '{t}' AS term, bucket, CAST(coalesce(n{k}, 0) AS BIGINT) AS count FROM joined" for k, t in enumerate(TOPICS)))(lambda df: terms.terms_frequency(df, TOPICS, 14))
over_captures("top_terms", f", {_words('text', 2, ANALYTICS_STOPWORDS)} {_TOP}")(lambda df: terms.top_terms(df))
over_captures("co_occurring", f", {_words('text', 2, ANALYTICS_STOPWORDS, _has(OTHER))} SELECT term, count(*) AS count FROM words WHERE term <> '{OTHER}' GROUP BY term HAVING count(*) >= 2 ORDER BY count DESC, term LIMIT 50")(lambda df: terms.co_occurring(df, OTHER))
over_captures("spikes", f"{_series(TERM, 28)}, z AS (SELECT *, avg(count) OVER () AS mean, stddev_samp(count) OVER () AS std, count(*) OVER () AS n FROM series) SELECT bucket, count, round((count - mean) / std, 4) AS zscore FROM z WHERE n >= 3 AND std > 0 AND (count - mean) / std >= 1.0 AND count >= 3")(lambda df: terms.spikes(df, TERM, 28, 1.0))
over_captures("zscore_series", f"{_series(TERM, 14)} SELECT bucket, count, round(coalesce(CASE WHEN stddev_samp(count) OVER () > 0 THEN (count - avg(count) OVER ()) / stddev_samp(count) OVER () END, 0.0), 4) AS zscore FROM series")(lambda df: terms.zscores(terms.term_frequency(df, TERM, 14)))
over_captures("domain_breakdown", "SELECT domain, count(*) AS count FROM captures WHERE domain IS NOT NULL AND trim(domain) <> '' GROUP BY domain ORDER BY count DESC, domain LIMIT 20")(lambda df: terms.domain_breakdown(df))
over_captures("language_breakdown", "SELECT split_part(lower(replace(language, '_', '-')), '-', 1) AS language, count(*) AS count FROM captures GROUP BY 1 ORDER BY count DESC, language LIMIT 20")(lambda df: terms.language_breakdown(df))

# ---- topics ------------------------------------------------------------------------------------------------------------


def _lifecycle_sql(days: int) -> str:
    parts = []
    for k, t in enumerate(TOPICS):
        parts.append(f"SELECT '{t}' AS term, bucket, CAST(coalesce(n{k}, 0) AS BIGINT) AS count FROM joined")
    counts = ", ".join(f"count(*) FILTER (WHERE {_has(t)}) AS n{k}" for k, t in enumerate(TOPICS))
    return f""", {_calendar(days)},
counts AS (SELECT CAST(fetch_ts AS DATE) AS bucket, {counts} FROM captures WHERE {_tail(days)} GROUP BY 1),
joined AS (SELECT c.bucket, counts.* EXCLUDE (bucket) FROM calendar c LEFT JOIN counts USING (bucket)),
s AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY bucket) AS k, count(*) OVER (PARTITION BY term) AS n FROM ({' UNION ALL '.join(parts)})),
f AS (
  SELECT term, sum(count) AS total, max(bucket) AS today, max(count) FILTER (WHERE k = n) AS cur, coalesce(max(count) FILTER (WHERE k = n - 1), 0) AS yesterday,
         sum(count) FILTER (WHERE n - k < 7) AS last7, max(count) AS peak_count, arg_min(bucket, -count * 1000 + k) AS peak_day,
         coalesce(regr_slope(CAST(count AS DOUBLE), CAST(k AS DOUBLE)) FILTER (WHERE n - k < 7), 0.0) AS slope,
         avg(count) FILTER (WHERE n - k < 7) AS mean7, avg(count) FILTER (WHERE n - k < 14) AS mean14, count(*) FILTER (WHERE count > 0) AS active,
         min(bucket) FILTER (WHERE count > 0) AS first_seen, max(bucket) FILTER (WHERE count > 0) AS last_seen
  FROM s GROUP BY term)
SELECT term, CASE WHEN total = 0 THEN 'DORMANT' WHEN cur >= 1.5 * mean14 AND cur < yesterday THEN 'PEAKING' WHEN slope > 0 AND cur > mean7 AND active >= 2 THEN 'EXPANDING'
  WHEN first_seen >= today - INTERVAL 2 DAY AND total >= 3 THEN 'EMERGING' WHEN slope < 0 OR (last7 = 0 AND peak_count >= 3) THEN 'DECLINING' WHEN last7 < 3 THEN 'DORMANT' ELSE 'STABLE' END AS phase,
  round(slope, 4) AS slope_7d, peak_count, CASE WHEN total > 0 THEN peak_day END AS peak_date, first_seen, last_seen, CAST(total AS BIGINT) AS total FROM f"""


_MEMBERS = """, multi AS (
  SELECT parent_doc_or_dup_group AS grp FROM captures WHERE parent_doc_or_dup_group IS NOT NULL AND parent_doc_or_dup_group <> '' AND domain IS NOT NULL AND domain <> ''
  GROUP BY 1 HAVING count(DISTINCT domain) >= 2),
members AS (
  SELECT c.parent_doc_or_dup_group AS grp, c.domain, min(c.observed_ts) AS first_ts, first(c.url ORDER BY c.observed_ts NULLS LAST, c.capture_id) AS url, count(*) AS n
  FROM captures c JOIN multi m ON m.grp = c.parent_doc_or_dup_group WHERE c.domain IS NOT NULL AND c.domain <> '' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY first_ts NULLS LAST, domain) AS rn FROM members),
pairs AS (SELECT o.grp, o.domain AS origin, m.domain AS replica, o.first_ts AS origin_ts, m.first_ts, o.url AS origin_url, m.url FROM ranked o JOIN ranked m ON o.grp = m.grp AND o.rn = 1 AND m.rn > 1),
edges AS (SELECT origin, replica, count(*) AS count FROM pairs GROUP BY 1, 2)"""

over_captures("topic_lifecycles", _lifecycle_sql(30))(lambda df: topics.lifecycles(df, TOPICS, 30))
over_captures("emerging_terms", f", {_words('text', 2, ANALYTICS_STOPWORDS, _tail(7), ', CAST(fetch_ts AS DATE) AS day, domain')} SELECT term, count(*) AS count, min(day) AS first_seen, count(DISTINCT domain) AS domains_covered FROM words GROUP BY term HAVING count(*) >= 3 AND min(day) >= CAST((SELECT max(fetch_ts) FROM captures) AS DATE) - 2 ORDER BY count DESC, term LIMIT 20")(lambda df: topics.emerging(df))
over_captures("lead_times", f"{_MEMBERS} SELECT origin, count(*) AS replica_edges, round(avg(epoch(first_ts) - epoch(origin_ts)) / 60.0, 4) AS avg_lead_minutes FROM pairs GROUP BY origin")(lambda df: topics.lead_times(df).withColumn("avg_lead_minutes", F.round("avg_lead_minutes", 4)))
over_captures(
    "source_impact",
    f"""{_MEMBERS}, e AS (SELECT origin, sum(count) AS copies, count(*) AS degree FROM edges GROUP BY 1), own AS (SELECT domain, count(*) AS captures FROM captures WHERE domain <> '' GROUP BY 1),
lead AS (SELECT origin, avg(epoch(first_ts) - epoch(origin_ts)) / 60.0 AS m FROM pairs GROUP BY 1)
SELECT e.origin AS domain, round(copies * ln(1 + degree) + coalesce(ln(1 + own.captures) / ln(1 + (SELECT max(captures) FROM own)), 0.0), 4) AS impact_score, CAST(coalesce(own.captures, 0) AS BIGINT) AS captures, degree AS replica_edges, round(coalesce(m, 0.0), 2) AS avg_lead_minutes
FROM e LEFT JOIN own ON own.domain = e.origin LEFT JOIN lead USING (origin) ORDER BY impact_score DESC, captures DESC, domain LIMIT 20""",
)(lambda df: topics.source_impact(df))

# ---- sources -----------------------------------------------------------------------------------------------------------

over_captures("replication_map", f"{_MEMBERS} SELECT origin, replica, count FROM edges ORDER BY count DESC, origin, replica LIMIT 50")(lambda df: sources.replication_map(df).drop("sample_urls"))
over_captures("top_replicators", f"{_MEMBERS} SELECT replica AS domain, count(*) AS edges FROM edges GROUP BY 1 ORDER BY edges DESC, domain LIMIT 20")(lambda df: sources.top_replicators(df))
over_captures(
    "domain_rank",
    f"""{_MEMBERS.split('members AS')[0].rstrip().rstrip(',')}, st AS (
  SELECT domain, count(*) AS captures, avg(length(text)) AS al, count(m.grp) AS replicated FROM captures c LEFT JOIN multi m ON m.grp = c.parent_doc_or_dup_group WHERE domain <> '' GROUP BY domain),
v AS (SELECT domain, count(*) / 30.0 AS v FROM captures WHERE observed_ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}' GROUP BY 1),
j AS (SELECT st.*, coalesce(v, 0.0) AS v FROM st LEFT JOIN v USING (domain)),
w AS (SELECT *, max(captures) OVER () AS mc, min(al) OVER () AS lo, max(al) OVER () AS hi, max(v) OVER () AS mv FROM j)
SELECT domain, round(0.4 * ln(1 + captures) / ln(1 + mc) + 0.3 * (CASE WHEN hi > lo THEN (al - lo) / (hi - lo) ELSE 1.0 END) + 0.2 * (1 - replicated / captures) + 0.1 * (CASE WHEN mv > 0 THEN v / mv ELSE 0.0 END), 4) AS score,
  captures, round(replicated / captures, 4) AS replication_ratio, round(al, 1) AS avg_length, round(CAST(v AS DOUBLE), 4) AS velocity
FROM w ORDER BY score DESC, captures DESC, domain LIMIT 50""",
)(lambda df: sources.domain_rank(df, as_of()))
over_captures("freshness", f"SELECT domain, CAST(max(observed_ts) AS DATE) AS last_seen, CAST(greatest(0, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(observed_ts))) / 86400)) AS INTEGER) AS days_since_last, count(*) FILTER (WHERE observed_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS captures_7d, count(*) FILTER (WHERE observed_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS captures_30d FROM captures WHERE domain <> '' GROUP BY domain ORDER BY max(observed_ts) DESC, domain LIMIT 50")(lambda df: sources.freshness(df, as_of()))
over_captures("domain_terms", f", {_words('text', 3, SOURCE_STOPWORDS, 'domain = ' + chr(39) + 'src3.example' + chr(39))} SELECT term, count(*) AS count FROM words WHERE NOT regexp_matches(term, '^[0-9]+$') GROUP BY term ORDER BY count DESC, term LIMIT 20")(lambda df: sources.domain_terms(df.filter("domain = 'src3.example'")))
_STORY = f""", hits AS (SELECT * FROM captures WHERE {_has(TERM)} AND {_tail(30, 'observed_ts')} AND parent_doc_or_dup_group <> '' AND trim(domain) <> ''),
firsts AS (SELECT parent_doc_or_dup_group AS g, domain, count(*) AS n, min(observed_ts) AS ts FROM hits GROUP BY 1, 2),
origin AS (SELECT parent_doc_or_dup_group AS g, domain, observed_ts AS ts FROM (SELECT *, row_number() OVER (PARTITION BY parent_doc_or_dup_group ORDER BY observed_ts, capture_id) AS rn FROM hits) WHERE rn = 1),
story AS (SELECT f.g, sum(f.n) AS docs FROM firsts f GROUP BY 1 HAVING sum(f.n) >= 2)"""
over_captures(
    "story_origins",
    f"""{_STORY} SELECT s.g AS dup_group, o.domain AS origin_domain, CAST(s.docs AS BIGINT) AS docs, count(f.domain) AS replicas, coalesce(string_agg(f.domain, ',' ORDER BY f.ts, f.domain), '') AS replica_domains,
  round(coalesce((epoch(min(f.ts)) - epoch(any_value(o.ts))) / 60.0, 0.0), 2) AS lead_minutes
FROM story s JOIN origin o USING (g) LEFT JOIN firsts f ON f.g = s.g AND f.domain <> o.domain GROUP BY 1, 2, 3 ORDER BY replicas DESC, docs DESC, dup_group LIMIT 20""",
)(lambda df: sources.story_origins(df, TERM))
over_captures("publisher_firsts", f"{_STORY} SELECT f.domain, count(*) FILTER (WHERE f.domain = o.domain) AS firsts, count(*) AS participated FROM story s JOIN origin o USING (g) JOIN firsts f ON f.g = s.g GROUP BY 1 HAVING count(*) FILTER (WHERE f.domain = o.domain) > 0 ORDER BY firsts DESC, participated DESC, f.domain LIMIT 20")(lambda df: sources.publisher_firsts(df, TERM))

# ---- sentiment -----------------------------------------------------------------------------------------------------------

_LEX = lexicon.Lexicon(positive=frozenset({"the", "des", "los", "und"}), negative=frozenset({"that", "les", "que", "der"}), negations=frozenset({"and", "est", "con"}), intensifiers=frozenset({"with", "pour", "por"}))


def _scored(source: str, column: str = "text", keep: str = "capture_id") -> str:
    """pos, neg and score of each row of source."""
    return f"""toks AS (SELECT {keep}, w, generate_subscripts(w, 1) AS p, unnest(w) AS t FROM (SELECT {keep}, regexp_extract_all(lower({column}), '[a-z0-9]+') AS w FROM {source}) WHERE len(w) > 0),
near AS (SELECT {keep}, t, lag(t, 1) OVER o AS a, lag(t, 2) OVER o AS b, lag(t, 3) OVER o AS c FROM toks WINDOW o AS (PARTITION BY {keep.split(',')[0]} ORDER BY p)),
signed AS (
  SELECT {keep}, (CASE WHEN t IN ({sql_words(_LEX.positive)}) THEN 1 ELSE -1 END)
    * (CASE WHEN a IN ({sql_words(_LEX.negations)}) OR b IN ({sql_words(_LEX.negations)}) OR c IN ({sql_words(_LEX.negations)}) THEN -1 ELSE 1 END)
    * (1.0 + 0.5 * ({' + '.join(f"(CASE WHEN {x} IN ({sql_words(_LEX.intensifiers)}) THEN 1 ELSE 0 END)" for x in 'abc')})) AS w
  FROM near WHERE t IN ({sql_words(_LEX.positive | _LEX.negative)})),
sums AS (SELECT {keep.split(',')[0]} AS id, CAST(sum(greatest(w, 0)) AS DOUBLE) AS pos, CAST(sum(greatest(-w, 0)) AS DOUBLE) AS neg FROM signed GROUP BY 1)"""


_SCORE = "round(CASE WHEN coalesce(pos, 0) + coalesce(neg, 0) > 0 THEN (pos - neg) / (pos + neg) ELSE 0.0 END, 4)"
over_captures("sentiment_docs", f", {_scored('captures')} SELECT capture_id, coalesce(pos, 0.0) AS pos, coalesce(neg, 0.0) AS neg, {_SCORE} AS score, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INTEGER) AS tokens_scanned FROM captures LEFT JOIN sums ON id = capture_id")(lambda df: sentiment.scored(df.select("capture_id", "text"), lexicon=_LEX).drop("text"))
_SENT = f""", hits AS (SELECT * FROM captures WHERE {_has(OTHER)} AND {_tail(14)}), {_scored('hits')}, {_calendar(14)},
d AS (SELECT CAST(fetch_ts AS DATE) AS bucket, {_SCORE} AS score FROM hits LEFT JOIN sums ON id = capture_id),
a AS (SELECT bucket, count(*) AS docs, count(*) FILTER (WHERE score > 0) AS positive, count(*) FILTER (WHERE score < 0) AS negative, avg(score) AS s FROM d GROUP BY 1),
series AS (SELECT c.bucket, CAST(coalesce(docs, 0) AS BIGINT) AS docs, CAST(coalesce(positive, 0) AS BIGINT) AS positive, CAST(coalesce(negative, 0) AS BIGINT) AS negative, round(coalesce(s, 0.0), 4) AS avg_score FROM calendar c LEFT JOIN a USING (bucket))"""
over_captures("sentiment_series", f"{_SENT} SELECT * FROM series")(lambda df: sentiment.sentiment_series(df, OTHER, 14, lexicon=_LEX))
over_captures("market_heat", f"{_SENT}, k AS (SELECT *, row_number() OVER (ORDER BY bucket) AS k, count(*) OVER () AS n FROM series) SELECT CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(positive) AS BIGINT) AS positive, CAST(sum(negative) AS BIGINT) AS negative, round(coalesce(sum(positive) / nullif(sum(positive) + sum(negative), 0), 0.0), 4) AS positive_ratio, round(stddev_pop(avg_score), 4) AS volatility, round(coalesce(regr_slope(avg_score, CAST(k AS DOUBLE)) FILTER (WHERE k > n - 7), 0.0), 4) AS slope_7d FROM k")(lambda df: sentiment.market_heat(df, OTHER, 14, lexicon=_LEX))
over_captures(
    "topic_dominance",
    f""", hits AS (SELECT capture_id, trim(domain) AS domain, text FROM captures WHERE {_has(OTHER)} AND {_tail(14)} AND trim(domain) <> ''), {_scored('hits')},
d AS (SELECT domain, {_SCORE} AS score FROM hits LEFT JOIN sums ON id = capture_id), g AS (SELECT domain, count(*) AS doc_count, avg(CAST(round(score * 10000) AS BIGINT)) AS s FROM d GROUP BY 1)
SELECT domain, doc_count, round(doc_count / sum(doc_count) OVER (), 4) AS doc_fraction, round(s) / 10000 AS avg_sentiment FROM g ORDER BY doc_count DESC, domain LIMIT 10""",
)(lambda df: topics.dominance(df, OTHER, lexicon=_LEX))

# ---- quality ---------------------------------------------------------------------------------------------------------------

over_captures("topic_matrix", f", d AS (SELECT domain, count(*) AS domain_total, {', '.join(f'count(*) FILTER (WHERE {_has(t)}) AS n{k}' for k, t in enumerate(TOPICS))} FROM captures WHERE trim(domain) <> '' AND {_tail(30)} GROUP BY 1 ORDER BY domain_total DESC, domain LIMIT 20) " + " UNION ALL ".join(f"SELECT '{t}' AS term, domain, n{k} AS count, domain_total FROM d" for k, t in enumerate(TOPICS)))(lambda df: quality.topic_matrix(df, TOPICS))
_DUP = "content_hash IS NOT NULL AND trim(content_hash) <> '' AND EXISTS (SELECT 1 FROM captures o WHERE o.content_hash = c.content_hash AND o.capture_id <> c.capture_id{w})"
_NEAR = "trim(parent_doc_or_dup_group) <> '' AND parent_doc_or_dup_group <> doc_id AND EXISTS (SELECT 1 FROM captures o WHERE o.parent_doc_or_dup_group = c.parent_doc_or_dup_group AND o.capture_id <> c.capture_id{w})"
over_captures(
    "quality_snapshot",
    f"""SELECT count(*) AS total_captures, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty_text,
  round((SELECT count(*) FROM captures c WHERE {_DUP.format(w='')}) / count(*), 6) AS duplicate_ratio, round((SELECT count(*) FROM captures c WHERE {_NEAR.format(w='')}) / count(*), 6) AS near_duplicate_ratio,
  round(avg(length(coalesce(text, ''))), 4) AS avg_length, (SELECT count(*) FROM (SELECT 1 FROM captures WHERE trim(parent_doc_or_dup_group) <> '' GROUP BY parent_doc_or_dup_group HAVING count(*) >= 2)) AS dedup_group_count,
  round(count(*) / ((epoch(max(fetch_ts)) - epoch(min(fetch_ts))) / 86400), 4) AS capture_rate_per_day FROM captures""",
)(lambda df: quality.quality_snapshot(df))
over_captures("snapshot_languages", "SELECT coalesce(nullif(trim(split_part(lower(replace(language, '_', '-')), '-', 1)), ''), 'unknown') AS language, count(*) AS count FROM captures GROUP BY 1 ORDER BY count DESC, language LIMIT 10")(lambda df: quality.snapshot_languages(df))
_SAME_DAY = " AND CAST(o.fetch_ts AS DATE) = CAST(c.fetch_ts AS DATE)"
over_captures(
    "quality_history",
    f""", e AS (SELECT CAST(max(fetch_ts) AS DATE) AS end_day, CAST(max(fetch_ts) AS DATE) - 29 AS start_day FROM captures),
cal AS (SELECT CAST(unnest(generate_series(start_day, end_day, INTERVAL 1 DAY)) AS DATE) AS bucket FROM e),
t AS (SELECT CAST(fetch_ts AS DATE) AS bucket, count(*) AS total, avg(length(coalesce(text, ''))) AS al FROM captures GROUP BY 1),
d AS (SELECT CAST(fetch_ts AS DATE) AS bucket, count(*) AS n FROM captures c WHERE {_DUP.format(w=_SAME_DAY)} GROUP BY 1),
r AS (SELECT CAST(fetch_ts AS DATE) AS bucket, count(*) AS n FROM captures c WHERE {_NEAR.format(w=_SAME_DAY)} GROUP BY 1),
f AS (SELECT CAST(ft AS DATE) AS bucket, count(*) AS n FROM (SELECT min(fetch_ts) AS ft FROM captures WHERE trim(domain) <> '' GROUP BY domain) GROUP BY 1)
SELECT cal.bucket, CAST(coalesce(total, 0) AS BIGINT) AS total, round(coalesce(coalesce(d.n, 0) / total, 0.0), 6) AS duplicate_ratio, round(coalesce(coalesce(r.n, 0) / total, 0.0), 6) AS near_duplicate_ratio,
  round(coalesce(al, 0.0), 4) AS avg_length, CAST(coalesce(f.n, 0) AS BIGINT) AS new_domains, round(CAST(coalesce(total, 0) AS DOUBLE), 4) AS capture_rate
FROM cal LEFT JOIN t ON t.bucket = cal.bucket LEFT JOIN d ON d.bucket = cal.bucket LEFT JOIN r ON r.bucket = cal.bucket LEFT JOIN f ON f.bucket = cal.bucket""",
)(lambda df: quality.quality_history(df))
over_captures("hash_multiplicity", "SELECT content_hash, count(*) AS copies FROM captures GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, content_hash LIMIT 20")(lambda df: quality.hash_multiplicity(df))
over_captures("quality_audit", 'SELECT count(*) AS "rows", round(count(*) FILTER (WHERE coalesce(trim(title), \'\') = \'\') / count(*), 6) AS empty_title, round(count(*) FILTER (WHERE length(coalesce(text, \'\')) < 200) / count(*), 6) AS short_text, round(count(*) FILTER (WHERE coalesce(trim(domain), \'\') = \'\') / count(*), 6) AS missing_domain, round(1 - count(DISTINCT content_hash) / count(content_hash), 6) AS hash_duplicates FROM captures')(lambda df: quality.audit(df))

# ---- catalogue -----------------------------------------------------------------------------------------------------------

_SLIM = ["capture_id", "doc_id", "domain", "fetch_ts", "content_hash"]
over_captures("captures_latest", "SELECT capture_id, doc_id, domain, content_hash FROM captures")(lambda df: catalog.latest_captures(df.select(*_SLIM).union(df.select("capture_id", "doc_id", "domain", (F.col("fetch_ts") - F.expr("interval 1 day")).alias("fetch_ts"), F.lit("old").alias("content_hash")))).drop("fetch_ts"))
for _u, _k in (("content", "content_hash"), ("group", "parent_doc_or_dup_group")):
    over_captures(f"captures_unique_{_u}", f"SELECT capture_id, {_k} AS fold FROM (SELECT *, row_number() OVER (PARTITION BY {_k} ORDER BY fetch_ts DESC, capture_id) AS rn FROM captures) WHERE rn = 1")(lambda df, u=_u, k=_k: catalog.folded(df, u).select("capture_id", F.col(k).alias("fold")))
over_captures("listing_page", "SELECT capture_id, domain FROM captures ORDER BY fetch_ts DESC, capture_id LIMIT 50 OFFSET 100")(lambda df: catalog.listing(df, 50, 100).select("capture_id", "domain"))
over_captures("listing_filtered", f"SELECT capture_id FROM captures WHERE fetch_ts >= TIMESTAMP '2024-01-05 00:00:00' AND lower(domain) = 'src2.example' AND (language = 'en' OR language LIKE 'en-%') AND (title ILIKE '%the%' OR text ILIKE '%the%')")(lambda df: catalog.filtered(df.filter(F.col("fetch_ts") >= F.expr("timestamp_ntz'2024-01-05 00:00:00'")), domain="SRC2.example", language="EN", query="the").select("capture_id"))
over_captures("counts", "SELECT 'source' AS kind, source_type AS key, count(*) AS count FROM captures GROUP BY source_type UNION ALL SELECT 'domain', domain, count(*) FROM captures GROUP BY domain UNION ALL SELECT 'language', split_part(lower(language), '-', 1), count(*) FROM captures GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM captures")(lambda df: catalog.counts(df))
over_captures("related_counts", "SELECT capture_id, count(*) OVER (PARTITION BY parent_doc_or_dup_group) - 1 AS related FROM captures")(lambda df: catalog.related_counts(df))
over_captures("related_captures", "SELECT capture_id FROM captures WHERE parent_doc_or_dup_group = (SELECT parent_doc_or_dup_group FROM captures WHERE capture_id = 'cap-2') AND capture_id <> 'cap-2' ORDER BY fetch_ts DESC, capture_id LIMIT 12")(lambda df: catalog.related(df, "cap-2").select("capture_id"))
over_captures("upsert_new", "SELECT capture_id FROM captures WHERE source_type <> 'src1'")(lambda df: catalog.upserted(df.filter("source_type = 'src1'"), df).select("capture_id"))
over_captures("upsert_conflicts", "SELECT capture_id FROM captures WHERE language = 'fr'")(lambda df: catalog.conflicts(df.select("capture_id", "language"), df.select("capture_id", F.when(F.col("language") != "fr", F.col("language")).alias("language"))))
over_tables("sql_passthrough", f"WITH {CAPTURES_SQL} SELECT domain, count(*) AS n FROM captures WHERE language = 'de' GROUP BY domain")(lambda spark, d: catalog.run_sql(spark, captures(spark, d), "SELECT domain, count(*) AS n FROM captures WHERE language = :lang GROUP BY domain", {"lang": "de"}))

# ---- text ------------------------------------------------------------------------------------------------------------------

over_captures("language_filter", "SELECT capture_id FROM captures WHERE language = 'es' OR language LIKE 'es-%'")(lambda df: df.filter(texts.language_filter("ES")).select("capture_id"))
_MARKS = ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({sql_words(frozenset(m))}))), 'lang': '{k}'}}" for k, m in sorted(texts.LANGUAGE_MARKS.items()))
over_captures("detected_language", f", t AS (SELECT *, regexp_extract_all(lower(text), '\\pL+') AS w FROM captures), c AS (SELECT capture_id, language, text, [{_MARKS}] AS m FROM t), b AS (SELECT *, list_max(m) AS best, list_sum(list_transform(m, lambda x: x.n)) AS total FROM c) SELECT capture_id, language, CASE WHEN length(text) >= 80 AND best.n > 0 AND best.n / total >= 0.5 THEN best.lang END AS detected FROM b")(lambda df: df.select("capture_id", "language", texts.detect_language(F.col("text")).alias("detected")))
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
over_captures("basic_clean", rf"SELECT capture_id, md5(regexp_replace({_CLEAN}, '^\s+|\s+$', '', 'g')) AS clean_md5 FROM captures")(lambda df: df.select("capture_id", F.md5(texts.basic_clean(F.col("text"), normalize=False).cast("binary")).alias("clean_md5")))
_STRIP = "'^[.,!?;:\"''()\\[\\]]+|[.,!?;:\"''()\\[\\]]+$'"
over_captures(
    "gate_reasons",
    rf""", w AS (SELECT capture_id, text, list_filter(str_split_regex(text, '\s+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS ls FROM captures),
m AS (SELECT capture_id, len(ws) AS n, length(regexp_replace(text, '\s+', '', 'g')) AS chars, len(regexp_extract_all(text, '#|\.\.\.|…')) AS symbols, len(ls) AS nl,
  len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[•*·‣◦\-]'))) AS bl, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS el,
  len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) AS al,
  len(list_filter(['be','to','of','and','that','have','with','the'], lambda s: list_contains(list_transform(ws, lambda x: lower(regexp_replace(x, {_STRIP}, '', 'g'))), s))) AS st FROM w)
SELECT capture_id, CASE WHEN n < 50 THEN 'too_few_words' WHEN n > 100000 THEN 'too_many_words' WHEN chars / n < 3.0 OR chars / n > 10.0 THEN 'mean_word_length' WHEN symbols / n > 0.10 THEN 'symbol_to_word_ratio'
  WHEN nl > 0 AND bl / nl > 0.9 THEN 'bullet_lines' WHEN nl > 0 AND el / nl > 0.3 THEN 'ellipsis_lines' WHEN al / n < 0.8 THEN 'low_alpha_fraction' WHEN st < 2 THEN 'no_stopwords' END AS reason FROM m""",
)(lambda df: df.select("capture_id", texts.gate_reason(F.col("text")).alias("reason")))
over_captures("safe_titles", "SELECT capture_id, substr(coalesce(nullif(trim(title), ''), ''), 1, 512) AS safe_title FROM captures WHERE trim(title) <> ''")(lambda df: df.filter(F.trim("title") != "").select("capture_id", texts.safe_title(F.col("title"), F.col("text")).alias("safe_title")))

# ---- dedup -------------------------------------------------------------------------------------------------------------------

_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"
over_captures("content_hashes", f"SELECT capture_id, md5({_NORM}) AS hash FROM captures")(lambda df: df.select("capture_id", dedup.content_hash(F.col("text")).alias("hash")))
over_captures("identities", f"SELECT md5(url || '::' || content_hash) AS doc, md5(md5(url || '::' || content_hash) || '|' || domain || '|' || url) AS capture FROM captures")(lambda df: df.select(dedup.doc_id_for(F.col("url"), F.col("content_hash")).alias("doc"), F.col("domain"), F.col("url")).select("doc", dedup.capture_id_for(F.col("doc"), F.col("domain"), F.col("url")).alias("capture")))
over_captures("exact_decisions", "SELECT capture_id, CASE WHEN rn = 1 THEN 'NEW' WHEN doc_id = fd THEN 'REVISION' ELSE 'EXACT_DUP' END AS decision, fd AS first_doc FROM (SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS fd FROM captures WINDOW w AS (PARTITION BY content_hash ORDER BY observed_ts, capture_id))")(lambda df: dedup.exact_decisions(df))
over_captures("token_sketches", f"SELECT capture_id, CASE WHEN len(u) > 0 THEN md5(array_to_string(u, ' ')) END AS token_hash, CAST(nullif(len(u), 0) AS INTEGER) AS token_count FROM (SELECT capture_id, list_sort(list_distinct(list_filter(string_split({_NORM}, ' '), lambda x: x <> ''))) AS u FROM captures)")(lambda df: df.select("capture_id", dedup.token_sketch(F.col("text")).alias("s")).select("capture_id", "s.*"))
_SIGS = f""", n AS (SELECT capture_id, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS t FROM captures),
tk AS (SELECT capture_id, unnest(t) AS w, generate_subscripts(t, 1) AS p, len(t) AS n FROM n WHERE len(t) > 0),
g AS (SELECT capture_id, md5(w || ' ' || a || ' ' || b) AS h FROM (SELECT *, lead(w, 1) OVER o AS a, lead(w, 2) OVER o AS b FROM tk WINDOW o AS (PARTITION BY capture_id ORDER BY p)) WHERE b IS NOT NULL
  UNION ALL SELECT capture_id, md5(array_to_string(t, ' ')) FROM n WHERE len(t) IN (1, 2)),
d AS (SELECT capture_id, i, instr('0123456789abcdef', substr(h, i, 1)) - 1 AS v FROM g CROSS JOIN (SELECT unnest(generate_series(1, 32)) AS i)),
b AS (SELECT capture_id, i, {' + '.join(f'(CASE WHEN 2 * sum((v >> {k}) & 1) >= count(*) THEN {1 << k} ELSE 0 END)' for k in range(4))} AS x FROM d GROUP BY 1, 2),
sig AS (SELECT capture_id, string_agg(substr('0123456789abcdef', CAST(x AS INTEGER) + 1, 1), '' ORDER BY i) AS signature FROM b GROUP BY 1)"""


def _signature(df: DataFrame) -> DataFrame:
    sig = dedup.signatures(df.select("capture_id", "text"), key="capture_id").filter("hi IS NOT NULL")
    return sig.select("capture_id", F.lower(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))).alias("signature"))


over_captures("signatures", f"{_SIGS} SELECT capture_id, signature FROM sig")(_signature)
over_captures("band_rows", f"{_SIGS}, seg AS (SELECT unnest(generate_series(0, 15)) AS seg) SELECT capture_id, CAST(seg AS INTEGER) AS seg, CAST((instr('0123456789abcdef', substr(signature, 31 - 2 * CAST(seg AS INTEGER), 1)) - 1) * 16 + instr('0123456789abcdef', substr(signature, 32 - 2 * CAST(seg AS INTEGER), 1)) - 1 AS INTEGER) AS seg_value FROM sig CROSS JOIN seg")(lambda df: dedup.band_rows(dedup.signatures(df.select("capture_id", "text"), key="capture_id"), "capture_id"))
over_captures("dedup_stats", "SELECT count(DISTINCT content_hash) AS distinct_hashes, count(*) AS captures FROM captures")(lambda df: dedup.dedup_stats(df))

# ---- search ------------------------------------------------------------------------------------------------------------------

_POST = f""", toks AS (SELECT capture_id, 0 AS f, unnest(regexp_extract_all(lower(title), '\\pL+')) AS term FROM captures UNION ALL SELECT capture_id, 1, unnest(regexp_extract_all(lower(text), '\\pL+')) FROM captures),
post AS (SELECT term, capture_id, count(*) FILTER (WHERE f = 0) AS tf_title, count(*) FILTER (WHERE f = 1) AS tf_text FROM toks GROUP BY 1, 2)"""
_QUERY = ["theand", "of", "thereal", "eau"]
_BM25 = f"""{_POST}, q AS (SELECT * FROM post WHERE term IN ({', '.join(f"'{t}'" for t in _QUERY)})),
st AS (SELECT count(*) AS docs, greatest(1.0, avg(length(title))) AS mean_title, greatest(1.0, avg(length(text))) AS mean_text FROM captures),
fr AS (SELECT term, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM q GROUP BY 1) CROSS JOIN st),
sc AS (SELECT q.capture_id, fr.idf, 2.0 * tf_title / greatest(1e-4, 1 + 0.3 * (length(title) / mean_title - 1)) + tf_text / greatest(1e-4, 1 + 0.75 * (length(text) / mean_text - 1)) AS tf FROM q JOIN fr USING (term) JOIN captures c ON c.capture_id = q.capture_id CROSS JOIN st),
scored AS (SELECT capture_id, sum(idf * tf / (1.2 + tf)) AS score FROM sc GROUP BY 1)"""
over_captures("bm25_scores", f"{_BM25} SELECT capture_id, round(score, 6) AS score FROM scored")(lambda df: search.bm25f(df, _QUERY).withColumn("score", F.round("score", 6)))
over_captures("document_frequencies", f"{_POST} SELECT term, count(*) AS df FROM post GROUP BY term")(lambda df: search.document_frequencies(search.postings(df)))
over_captures("substring_search", "SELECT capture_id FROM captures WHERE title ILIKE '%theand%' OR text ILIKE '%theand%'")(lambda df: search.substring_matches(df, ["theand"]).select("capture_id"))
over_captures("phrase_search", "SELECT capture_id FROM captures WHERE title ILIKE '%of the%' OR text ILIKE '%of the%'")(lambda df: search.phrase_matches(df, search.phrase_of('"of the"')).select("capture_id"))
over_captures("facets", "SELECT facet, value, count FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS rn FROM (SELECT 'domain' AS facet, lower(trim(domain)) AS value, count(*) AS count FROM captures GROUP BY 2 UNION ALL SELECT 'source', lower(trim(source_type)), count(*) FROM captures GROUP BY 2 UNION ALL SELECT 'language', split_part(lower(language), '-', 1), count(*) FROM captures GROUP BY 2)) WHERE rn <= 10")(lambda df: search.facets(df))
over_captures("collapsed_search", "SELECT capture_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_doc_or_dup_group ORDER BY fetch_ts DESC, capture_id) AS rn FROM captures WHERE title ILIKE '%the%' OR text ILIKE '%the%') WHERE rn = 1")(lambda df: search.collapsed(search.substring_matches(df, ["the"]), *search.newest_first()).select("capture_id"))
over_captures("search_page")(lambda df: search.search(df, "theand of", prune=False).rows.select("capture_id", "final_score", "snippet"))

# ---- alerts and other series -------------------------------------------------------------------------------------------------

RULES = [alerts.Rule(1, "a", "the", "term_count", 3, 24), alerts.Rule(2, "b", "que", "term_spike", 2, 48), alerts.Rule(3, "c", "zzzz", "term_count", 1, 24), alerts.Rule(4, "d", "der", "term_spike", 1, 12)]


def _alert_sql() -> str:
    rows = []
    for r in RULES:
        start = f"TIMESTAMP '{AS_OF}' - INTERVAL {int(r.window_hours)} HOUR"
        rows.append(f"SELECT {r.id} AS rule_id, '{r.kind}' AS kind, '{r.term}' AS term, {float(r.threshold)} AS threshold, count(*) FILTER (WHERE fetch_ts >= {start} AND fetch_ts < TIMESTAMP '{AS_OF}') AS count, count(*) FILTER (WHERE fetch_ts >= {start} - INTERVAL 7 DAY AND fetch_ts < {start}) / 7 AS baseline FROM captures WHERE {_has(r.term)}")
    return f", r AS ({' UNION ALL '.join(rows)}), q AS (SELECT *, CAST(CASE WHEN kind = 'term_spike' THEN greatest(threshold, CASE WHEN baseline > 0 THEN 3 * baseline ELSE 3.0 END) ELSE threshold END AS DOUBLE) AS required FROM r) SELECT rule_id, kind, term, count, round(baseline, 4) AS baseline, round(required, 4) AS required, count >= required AS fired FROM q"


over_captures("alerts_evaluated", _alert_sql())(lambda df: alerts.evaluated(df, RULES, as_of()))
over_tables("alert_weekdays", "SELECT CAST(d.d AS INTEGER) AS weekday, count(e.ts) AS count FROM (SELECT unnest(generate_series(0, 6)) AS d) d LEFT JOIN events e ON isodow(e.ts) - 1 = d.d AND e.event_type = 'purchase' GROUP BY 1")(lambda spark, d: alerts.by_weekday(table(spark, d, "events").filter("event_type = 'purchase'"), "ts"))
over_captures(
    "correlation_lags",
    f"{_series(TERM, 30)}, other AS (SELECT CAST(fetch_ts AS DATE) AS bucket, count(*) AS n FROM captures WHERE {_has('der')} AND {_tail(30)} GROUP BY 1), x AS (SELECT row_number() OVER (ORDER BY s.bucket) AS k, s.count AS x, coalesce(o.n, 0) AS y FROM series s LEFT JOIN other o USING (bucket)), l AS (SELECT unnest(generate_series(-3, 3)) AS lag), r AS (SELECT lag, round(corr(a.x, b.y), 4) AS r FROM l CROSS JOIN x a JOIN x b ON b.k = a.k - lag GROUP BY lag) SELECT lag, r, row_number() OVER (ORDER BY abs(r) DESC, abs(lag), lag) = 1 AS best FROM r",
)(lambda df: crosssource.lagged_correlation(df, TERM, "der"))
over_tables("session_authors", "SELECT role AS author, count(*) AS count FROM conversations GROUP BY 1 ORDER BY count DESC, author LIMIT 20")(lambda spark, d: crosssource.session_authors(table(spark, d, "conversations"), "role"))

# ---- digests and exports -----------------------------------------------------------------------------------------------------

_NOW = f"observed_ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}'"
over_captures("digest_metrics", f", a AS (SELECT count(*) FILTER (WHERE {_NOW}) AS captures, count(*) FILTER (WHERE observed_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND observed_ts < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS previous, count(DISTINCT CASE WHEN {_NOW} AND trim(domain) <> '' THEN domain END) AS domains FROM captures), n AS (SELECT count(*) AS new_domains FROM (SELECT min(observed_ts) AS f FROM captures GROUP BY domain) WHERE f BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}') SELECT captures, previous, round((captures - previous) / nullif(previous, 0), 4) AS growth, domains, new_domains FROM a CROSS JOIN n")(lambda df: digest.digest_metrics(df, as_of()))
over_captures("digest_terms", f", t AS (SELECT unnest(regexp_extract_all(lower(title || ' ' || text), '\\pL+')) AS term FROM captures WHERE {_NOW}) SELECT term, count(*) AS count FROM t WHERE length(term) >= 3 AND term NOT IN ({sql_words(DIGEST_STOPWORDS)}) GROUP BY 1 ORDER BY count DESC, term LIMIT 20")(lambda df: digest.digest_terms(df, as_of()))
over_captures("digest_terms_whole", f", t AS (SELECT unnest(regexp_extract_all(lower(concat_ws(' ', title, text)), '\\pL+')) AS term FROM captures WHERE {_NOW}) SELECT term, count(*) AS count FROM t WHERE length(term) >= 3 AND term NOT IN ({sql_words(DIGEST_STOPWORDS)}) GROUP BY 1 ORDER BY count DESC, term LIMIT 20")(lambda df: digest.digest_terms(df, as_of()))
over_captures("title_bigrams", f", t AS (SELECT capture_id, list_filter(regexp_extract_all(lower(title), '\\pL+'), lambda x: length(x) >= 3 AND x NOT IN ({sql_words(DIGEST_STOPWORDS)})) AS w FROM captures WHERE {_NOW}), u AS (SELECT capture_id, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM t WHERE len(w) > 0), b AS (SELECT a || ' ' || lead(a) OVER (PARTITION BY capture_id ORDER BY p) AS term FROM u) SELECT term, count(*) AS count FROM b WHERE term IS NOT NULL GROUP BY 1 ORDER BY count DESC, term LIMIT 20")(lambda df: digest.title_bigrams(df, as_of()))
over_captures("llm_export", "SELECT md5(regexp_replace(title || chr(10) || chr(10) || text, '^\\n+|\\n+$', '', 'g')) AS output_md5, capture_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_doc_or_dup_group ORDER BY observed_ts, capture_id) AS rn FROM captures) WHERE rn = 1")(lambda df: digest.llm_records(df).select(F.md5(F.col("output").cast("binary")).alias("output_md5"), "metadata.capture_id"))
over_captures("export_rows", "SELECT capture_id FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY fetch_ts DESC, capture_id) AS rn FROM captures WHERE source_type = 'src0') WHERE rn = 1 ORDER BY fetch_ts DESC, capture_id LIMIT 1000")(lambda df: digest.exported(df, "content", source="src0").select("capture_id"))

# ---- entities, URLs, pages -------------------------------------------------------------------------------------------------

over_captures("entity_trend", f", c AS (SELECT CAST(fetch_ts AS DATE) AS bucket, count(*) AS n FROM captures WHERE {_has('der')} GROUP BY 1), cal AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS bucket FROM (SELECT min(bucket) AS a, max(bucket) AS b FROM c)) SELECT cal.bucket, CAST(coalesce(n, 0) AS BIGINT) AS count FROM cal LEFT JOIN c ON c.bucket = cal.bucket")(lambda df: entities.entity_trend(df, "der"))
_CANONICAL = r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^((www|m|mobile|amp)[.])+', '') AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid)=') AND NOT regexp_matches(x, '^(page|p|paged|pg)=(0?1)?$')) AS q FROM pages),
c AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(path, '[.]html?$', ''), '(.)/$', '\1'), ''), '/') AS plain, array_to_string(list_sort(q), '&') AS kept FROM p)
SELECT page_id, url, 'https://' || host || plain || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS site FROM c"""
over_tables("canonical_urls", _CANONICAL)(lambda spark, d: urls.with_canonical(table(spark, d, "pages").select("page_id", "url")))
over_tables("html_text")(lambda spark, d: html.html_to_text(table(spark, d, "pages")).select("page_id", "title", "language", F.length("text").alias("n_chars")))

# ---- jobs, queues and metrics over the event tables ---------------------------------------------------------------------------

_JOBS = "SELECT o_orderkey AS position, CASE o_orderkey % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'ats' WHEN 2 THEN 'remotive' ELSE 'wwr' END AS source, o_totalprice AS score FROM orders"


def _listings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    return o.select(F.col("o_orderkey").alias("position"), F.when(k == 0, "linkedin").when(k == 1, "ats").when(k == 2, "remotive").otherwise("wwr").alias("source"), F.col("o_totalprice").alias("score"))


over_tables("jobs_diversified", f"WITH j AS ({_JOBS}), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, position) AS p FROM j), t AS (SELECT *, CASE WHEN source = 'linkedin' AND p <= 12 THEN 0 WHEN source = 'linkedin' THEN p - 12 ELSE p END AS turn, CASE WHEN source = 'linkedin' AND p <= 12 THEN p ELSE 0 END AS q, CASE source WHEN 'linkedin' THEN 0 WHEN 'ats' THEN 1 ELSE 2 END AS k FROM p) SELECT position, source FROM t ORDER BY turn, q, k, source LIMIT 40")(lambda spark, d: jobs.diversified(_listings(spark, d), [F.desc("score"), F.col("position")], 40).select("position", "source"))
over_tables("jobs_deduped", "SELECT min(o_orderkey) AS position FROM orders GROUP BY o_custkey")(lambda spark, d: jobs.deduped(table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("https://Jobs.example/"), F.col("o_custkey").cast("string"), F.lit("/")).alias("url"), F.lit("s").alias("source"), F.lit("c").alias("company"), F.col("o_custkey").cast("string").alias("title"), F.lit("l").alias("location"))).select("position"))
over_tables("status_counts", "SELECT user_id AS job_id, event_type AS status, count(*) AS count FROM events GROUP BY 1, 2")(lambda spark, d: operations.status_counts(table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"))))
over_tables("last_checkpoints", "SELECT user_id AS partition_key, arg_max(event_id, event_id) AS checkpoint FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY 1")(lambda spark, d: operations.last_checkpoints(table(spark, d, "events").select(F.col("user_id").alias("partition_key"), F.col("event_id").alias("checkpoint"), F.col("event_id").alias("task_id"), F.col("ts").alias("completed_at"), F.lit("completed").alias("status"))))
over_tables("percentiles", "WITH r AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT name, max(value) FILTER (WHERE k = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, max(value) FILTER (WHERE k = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95 FROM r GROUP BY 1")(lambda spark, d: operations.percentiles(table(spark, d, "events").select(F.col("event_type").alias("name"), "value"), {"p50": 0.5, "p95": 0.95}))
over_tables("backlog", "SELECT count(*) AS files, CAST(sum(user_id) AS BIGINT) AS records, CAST(sum(event_id) AS BIGINT) AS bytes, CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') - floor(epoch(min(ts))) AS BIGINT) AS oldest_seconds FROM events WHERE event_type <> 'purchase'")(lambda spark, d: operations.backlog(table(spark, d, "events").select(F.col("user_id").alias("records"), F.col("event_id").alias("bytes"), F.col("ts").alias("created_at"), (F.col("event_type") == "purchase").alias("compacted")), F.expr("timestamp_ntz'2024-03-01 00:00:00'")))
over_tables("feed_health", "SELECT user_id AS feed, count(*) AS fetches, round(100 * count(*) FILTER (WHERE event_type = 'error') / count(*), 2) AS error_percent, round(greatest(0.0, least(100.0, 100 - 10 * (100 * count(*) FILTER (WHERE event_type = 'error') / count(*)) - 5 * (100 * count(*) FILTER (WHERE event_type = 'purchase') / count(*)))), 2) AS score FROM events GROUP BY 1")(lambda spark, d: operations.feed_health(table(spark, d, "events").select(F.col("user_id").alias("feed"), F.when(F.col("event_type") == "purchase", 500).otherwise(200).alias("status"), F.when(F.col("event_type") == "error", "x").alias("error"))))

# ---- streams ---------------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d.rstrip('/')}/events.parquet"
    return streams.file_stream(spark, path if spark.read.parquet(path).inputFiles()[0].rstrip("/").rpartition("/")[0].endswith("events.parquet") else f"{d.rstrip('/')}/events.parquet*", table(spark, d, "events").schema)


def _named(rows: DataFrame) -> DataFrame:
    """Window bounds as seconds, whatever the session's time zone."""
    return rows.withColumn("start", F.unix_seconds("start")).withColumn("end", F.unix_seconds("end"))


def _epoch(c: str) -> str:
    return f"CAST(epoch({c}) AS BIGINT)"


over_tables("stream_tumbling", 'SELECT CAST(epoch(date_trunc(\'day\', ts)) AS BIGINT) AS start, CAST(epoch(date_trunc(\'day\', ts)) AS BIGINT) + 86400 AS "end", event_type, count(*) AS count FROM events GROUP BY date_trunc(\'day\', ts), event_type')(lambda spark, d: _named(streams.drained(streams.tumbling(_stream(spark, d), "1 day", "ts", "event_type"), "tidewrack_tumbling", "complete")))
over_tables("stream_sliding", 'WITH w AS (SELECT CAST(epoch(date_trunc(\'day\', ts)) AS BIGINT) - k * 86400 AS start FROM events CROSS JOIN (VALUES (0), (1)) v(k)) SELECT start, start + 172800 AS "end", count(*) AS count FROM w GROUP BY start')(lambda spark, d: _named(streams.drained(streams.sliding(_stream(spark, d), "2 days", "1 day"), "tidewrack_sliding", "complete")))
over_tables("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")(lambda spark, d: streams.drained(streams.distinct_keys(_stream(spark, d).select("user_id", "event_type"), "user_id", "event_type"), "tidewrack_first_seen"))
over_tables("batch_sessions", 'WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS "end", count(*) AS count FROM n GROUP BY user_id, k')(lambda spark, d: _named(streams.sessions(table(spark, d, "events"))))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
