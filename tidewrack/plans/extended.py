"""More of the registered queries: other series, alerts, task tables, lookups, and round trips through files."""

from __future__ import annotations

from datetime import date, datetime
from html import unescape
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import html, langprofile, maintext, stemmer, urls
from tidewrack.functions import text as texts
from tidewrack.functions.tokens import ANALYTICS_STOPWORDS, SOURCE_STOPWORDS, sql_words
from tidewrack.functions.windows import bucket
from tidewrack.operators import alerts, briefing, catalog, crosssource, dedup, digest, entities, jobs, operations, quality, search, sentiment, sources, substrings, terms
from tidewrack.plans import registry
from tidewrack.plans.registry import AS_OF, OTHER, RULES, TERM, TOPICS, as_of, over_captures, over_tables
from tidewrack.session import shared_subdir
from tidewrack.sources import datasource, jsonl, web
from tidewrack.sources.testdata import CAPTURES_SQL, captures, table
from tidewrack.streaming import stateful, streams


def ntz(said: str):
    return F.expr(f"timestamp_ntz'{said}'")


def write_lines(lines: DataFrame, name: str) -> str:
    """A one-column table as text files in the shared folder; returns the folder."""
    folder = shared_subdir(lines.sparkSession, name)
    lines.write.text(folder)
    return folder


# ---- other series ------------------------------------------------------------------------------------------------------

over_captures(
    "compared_series",
    f"""{registry._series(TERM, 14)}, o AS (SELECT CAST(fetch_ts AS DATE) AS bucket, count(*) AS y FROM captures WHERE {registry._has('der')} AND {registry._tail(14)} GROUP BY 1),
b AS (SELECT CAST(s.count AS DOUBLE) AS x, CAST(coalesce(y, 0) AS DOUBLE) AS y FROM series s LEFT JOIN o USING (bucket))
SELECT round(coalesce(corr(x, y), 0.0), 4) AS r, count(*) AS days, CAST(sum(x) AS BIGINT) AS local_total, CAST(sum(y) AS BIGINT) AS external_total FROM b""",
)(lambda df: crosssource.compared(terms.term_frequency(df, TERM, 14), terms.term_frequency(df, "der", 14)))
over_tables("rebucketed_weeks", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(date_trunc('week', day) AS DATE) AS bucket, CAST(sum(n) AS BIGINT) AS count, bool_or(n > 360) AS truncated FROM d GROUP BY 1")(
    lambda spark, d: crosssource.rebucketed(table(spark, d, "events").groupBy(F.to_date("ts").alias("bucket")).agg(F.count("*").alias("count")).withColumn("truncated", F.col("count") > 360), bucket(F.col("bucket"), "week"))
)
over_captures("coverage_gaps", "SELECT language AS term, CAST(count(*) FILTER (WHERE source_type = 'src1') AS BIGINT) AS local, count(*) AS external, coalesce(count(*) >= 25 AND count(*) FILTER (WHERE source_type = 'src1') / count(*) < 0.1, false) AS gap FROM captures GROUP BY language")(
    lambda df: crosssource.coverage_gaps(df.filter("source_type = 'src1'").groupBy(F.col("language").alias("term")).count(), df.groupBy(F.col("language").alias("term")).count())
)
over_tables("joint_correlation", "WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS y FROM events GROUP BY 1) SELECT CASE WHEN count(*) >= 3 THEN round(coalesce(corr(x, y), 0.0), 4) END AS r FROM d WHERE x <> 0 AND y <> 0")(
    lambda spark, d: crosssource.joint_correlation(table(spark, d, "events").groupBy(F.to_date("ts")).agg(F.count_if(F.col("event_type") == "click").alias("x"), F.count_if(F.col("event_type") == "purchase").alias("y")), "x", "y")
)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("tweet_id"), F.col("role").alias("username"), "text")


over_tables("session_terms", f"SELECT term, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conversations) WHERE term NOT IN ({sql_words(ANALYTICS_STOPWORDS)}) GROUP BY 1 ORDER BY count DESC, term LIMIT 20")(lambda spark, d: crosssource.session_terms(_messages(spark, d), ANALYTICS_STOPWORDS))
over_tables("stored_messages", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS VARCHAR) AS tweet_id FROM conversations WHERE conv_id % 2 = 1")(
    lambda spark, d: crosssource.stored_messages(_messages(spark, d).filter("cast(session_id as bigint) % 2 = 0"), _messages(spark, d).union(_messages(spark, d))).select("session_id", "tweet_id")
)
_HITS = registry._scored("captures").replace(" * (1.0 + 0.5 * (", " * (1.0 + 0.0 * (")  # intensifiers count for nothing
_DAYS = f"""{_HITS}, day AS (SELECT CAST(fetch_ts AS DATE) AS bucket, coalesce(pos, 0) AS p, coalesce(neg, 0) AS n FROM captures LEFT JOIN sums ON id = capture_id),
timeline AS (SELECT bucket, count(*) FILTER (WHERE p > n) AS positive, count(*) FILTER (WHERE n > p) AS negative, count(*) FILTER (WHERE n = p) AS neutral, round(avg((p - n) / (p + n + 1e-9)), 4) AS score FROM day GROUP BY 1)"""


def _timeline(df: DataFrame) -> DataFrame:
    return crosssource.session_timeline(df.select(F.col("fetch_ts").alias("created_at"), "text"), registry._LEX)


over_captures("session_timeline", f", {_DAYS} SELECT * FROM timeline")(_timeline)
over_captures(
    "combined_view",
    f""", {_DAYS}, b AS (SELECT coalesce(c.bucket, t.bucket) AS bucket, coalesce(c.n, 0.0) AS news, coalesce(t.score, 0.0) AS other FROM (SELECT bucket, score / 2 AS n FROM timeline WHERE positive > 8) c FULL JOIN timeline t ON t.bucket = c.bucket)
SELECT bucket, news, other, CASE WHEN avg(news) OVER () = 0 OR avg(other) OVER () = 0 THEN 'neutral' WHEN sign(avg(news) OVER ()) = sign(avg(other) OVER ()) THEN 'converging' ELSE 'diverging' END AS verdict FROM b""",
)(lambda df: crosssource.combined(_timeline(df).filter("positive > 8").select("bucket", (F.col("score") / 2).alias("avg_score")), _timeline(df)))

# ---- alerts and briefings ------------------------------------------------------------------------------------------------

_FIRINGS = f"firings AS (SELECT user_id % 4 + 1 AS rule_id, ts AS fired_at FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '{AS_OF}' - (5 - user_id % 4) * INTERVAL 25 MINUTE)"


def _firings(spark: SparkSession, d: str, at: str = AS_OF) -> DataFrame:
    rows = table(spark, d, "events").filter("event_type = 'purchase'").select((F.col("user_id") % 4 + 1).cast("int").alias("rule_id"), F.col("ts").cast("timestamp_ntz").alias("fired_at"))
    return rows.filter(F.col("fired_at") <= ntz(at) - F.make_dt_interval(mins=(6 - F.col("rule_id")) * 25))


_AT = "2024-01-20 12:00:00"
_FIRED = registry._alert_sql().replace(AS_OF, _AT).partition("SELECT rule_id, kind, term, count, round(baseline")[0]
over_tables("alerts_fired", f"WITH {CAPTURES_SQL}{_FIRED}, {_FIRINGS.replace(AS_OF, _AT)}, last AS (SELECT rule_id, max(fired_at) AS f FROM firings GROUP BY 1) SELECT q.rule_id, q.count FROM q LEFT JOIN last USING (rule_id) WHERE q.count >= required AND (f IS NULL OR epoch(TIMESTAMP '{_AT}') - floor(epoch(f)) >= 3600)")(
    lambda spark, d: alerts.fired(captures(spark, d, False), RULES, ntz(_AT), _firings(spark, d, _AT)).select("rule_id", "count")
)
over_tables("weekly_firings", f"WITH {_FIRINGS} SELECT rule_id, count(*) AS count, CAST(floor(epoch(max(fired_at))) AS BIGINT) AS last_fired FROM firings WHERE fired_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1")(lambda spark, d: alerts.weekly(_firings(spark, d), as_of() - F.expr("interval 7 days")).withColumn("last_fired", F.unix_seconds(F.col("last_fired").cast("timestamp"))))
over_tables("newest_firings", f"WITH {_FIRINGS} SELECT rule_id, CAST(floor(epoch(fired_at)) AS BIGINT) AS fired FROM firings ORDER BY fired_at DESC, rule_id LIMIT 50")(lambda spark, d: alerts.newest_firings(_firings(spark, d)).select("rule_id", F.unix_seconds(F.col("fired_at").cast("timestamp")).alias("fired")))
_TERMS_SQL = registry.oracle_sql()["terms_frequency"]
over_tables("movers", f"WITH s AS ({_TERMS_SQL}), z AS (SELECT *, avg(count) OVER w AS mean, stddev_samp(count) OVER w AS std, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY term)) SELECT term, bucket, count, round((count - mean) / std, 4) AS zscore FROM z WHERE n >= 3 AND std > 0 AND (count - mean) / std >= 1.0 AND count >= 3")(lambda spark, d: briefing.movers(captures(spark, d, False), TOPICS, 14, 1.0))
over_captures("sentiment_shift", f"{registry._SENT}, a2 AS (SELECT max(avg_score) FILTER (WHERE bucket = (SELECT max(bucket) FROM series WHERE docs > 0)) AS last, round(avg(avg_score) FILTER (WHERE bucket <> (SELECT max(bucket) FROM series WHERE docs > 0)), 4) AS before FROM series WHERE docs > 0) SELECT last, before, CASE WHEN last - before > 0.05 THEN 'up' WHEN last - before < -0.05 THEN 'down' ELSE 'flat' END AS shift FROM a2")(
    lambda df: briefing.sentiment_shift(df, OTHER, 14, registry._LEX)
)
over_captures(
    "quality_trend",
    f""", e AS (SELECT CAST(max(fetch_ts) AS DATE) AS end_day FROM captures), cal AS (SELECT CAST(unnest(generate_series(end_day - 13, end_day, INTERVAL 1 DAY)) AS DATE) AS bucket FROM e),
t AS (SELECT CAST(fetch_ts AS DATE) AS bucket, count(*) AS total FROM captures GROUP BY 1), d AS (SELECT CAST(fetch_ts AS DATE) AS bucket, count(*) AS n FROM captures c WHERE {registry._DUP.format(w=registry._SAME_DAY)} GROUP BY 1),
h AS (SELECT round(coalesce(coalesce(d.n, 0) / total, 0.0), 6) AS ratio, row_number() OVER (ORDER BY cal.bucket DESC) AS k FROM cal LEFT JOIN t ON t.bucket = cal.bucket LEFT JOIN d ON d.bucket = cal.bucket)
SELECT round(avg(ratio) FILTER (WHERE k <= 7), 6) AS last7, round(avg(ratio) FILTER (WHERE k > 7), 6) AS before7 FROM h""",
)(lambda df: briefing.quality_trend(df))

# ---- task tables ---------------------------------------------------------------------------------------------------------

_CASE = "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' WHEN 'error' THEN 'dead' ELSE 'completed' END"
_TASKS = f"tasks AS (SELECT event_id AS task_id, user_id AS job_id, event_type || CAST(event_id % 50 AS VARCHAR) AS partition_key, {_CASE} AS status, user_id % 6 AS attempts, ts AS created_at FROM events)"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ts").cast("timestamp_ntz")
    return table(spark, d, "events").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("job_id"), F.concat("event_type", (F.col("event_id") % 50).cast("string")).alias("partition_key"), F.expr(_CASE).alias("status"), (F.col("user_id") % 6).alias("attempts"), at.alias("created_at"), at.alias("started_at"), at.alias("completed_at"), F.lit(None).cast("timestamp_ntz").alias("next_at"))


over_tables("retry_delays", f"WITH {_TASKS} SELECT DISTINCT attempts, least(3600.0, 30 * pow(2.0, greatest(0, attempts - 1))) AS delay FROM tasks")(lambda spark, d: _tasks(spark, d).select("attempts", operations.retry_delay(F.col("attempts")).alias("delay")).distinct())
over_tables("orphaned_tasks", f"WITH {_TASKS} SELECT task_id, CASE WHEN attempts >= 3 THEN 'dead_letter' ELSE 'requeue' END AS action FROM tasks WHERE status = 'running' AND epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(created_at)) > 3600")(lambda spark, d: operations.orphaned(_tasks(spark, d), ntz("2024-01-15 00:00:00"), 3600, 3).select("task_id", "action"))
over_tables("new_tasks", f"WITH {_TASKS} SELECT DISTINCT job_id, partition_key FROM tasks WHERE job_id % 3 <> 0")(lambda spark, d: operations.new_tasks(_tasks(spark, d).filter("job_id % 3 = 0"), _tasks(spark, d)).select("job_id", "partition_key"))
over_tables("expired_tasks", f"WITH {_TASKS} SELECT task_id FROM tasks WHERE status IN ('completed', 'failed') AND created_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 3 DAY")(lambda spark, d: operations.expired(_tasks(spark, d), ntz("2024-01-15 00:00:00"), 3).select("task_id"))
over_tables("claimed_tasks", f"WITH {_TASKS} SELECT task_id, 'running' AS status, attempts + 1 AS attempts FROM tasks WHERE status = 'pending' ORDER BY created_at, task_id LIMIT 100")(lambda spark, d: operations.claimed(_tasks(spark, d), 100, ntz("2024-03-01 00:00:00")).select("task_id", "status", "attempts"))
over_tables("rearmed_tasks", f"WITH {_TASKS} SELECT task_id, 'pending' AS status, 0 AS attempts FROM tasks WHERE status = 'dead' AND job_id % 2 = 0")(lambda spark, d: operations.rearmed(_tasks(spark, d), _tasks(spark, d).filter("job_id % 2 = 0")).select("task_id", "status", "attempts"))
over_tables("seed_progress", f"WITH {_TASKS} SELECT job_id AS seed, count(*) AS tasks, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'running') AS fetched FROM tasks GROUP BY 1")(
    lambda spark, d: operations.seed_progress(_tasks(spark, d).select(F.col("job_id").alias("seed"), "status"), _tasks(spark, d).filter("status = 'running'").select(F.col("job_id").alias("seed"), F.col("partition_key").alias("url")))
)
over_tables("subpartitioned_tasks", f"WITH {_TASKS}, s AS (SELECT DISTINCT job_id, partition_key || '/' || k AS partition_key FROM tasks CROSS JOIN (VALUES ('a'), ('b')) v(k) WHERE status = 'running') SELECT job_id, partition_key, 'pending' AS status FROM s")(
    lambda spark, d: operations.subpartitioned(_tasks(spark, d).filter("status = 'running'"), _tasks(spark, d).select("partition_key").distinct().withColumn("sub_key", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("sub_key", F.concat("partition_key", F.lit("/"), "sub_key")))
)
_PLAN = """r AS (SELECT o_custkey AS job_id, CASE o_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE 'NONE' END AS source, DATE '1996-01-01' + CAST(o_custkey % 2000 AS INTEGER) AS first, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 5 END AS max_tasks FROM orders GROUP BY o_custkey),
p AS (SELECT o_orderpriority AS source, o_orderkey AS partition_key, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 7 = 0)"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_custkey")
    first = F.date_add(F.lit(date(1996, 1, 1)), (k % 2000).cast("int"))
    requests = o.select("o_custkey").distinct().select(k.alias("job_id"), F.when(k % 3 == 0, "1-URGENT").when(k % 3 == 1, "5-LOW").otherwise("NONE").alias("source"), first.alias("first"), F.date_add(first, 20).alias("last"), F.when(k % 5 != 0, k % 5).alias("max_tasks"))
    day = F.to_date("o_orderdate")
    partitions = o.filter("o_orderkey % 7 = 0").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").cast("string").alias("partition_key"), day.alias("first"), F.date_add(day, 2).alias("last"))
    return operations.planned(requests, partitions)


over_tables(
    "planned_tasks",
    f"""WITH {_PLAN}, met AS (SELECT job_id, CAST(partition_key AS VARCHAR) AS partition_key, max_tasks, row_number() OVER (PARTITION BY job_id ORDER BY d, CAST(partition_key AS VARCHAR)) AS k FROM r JOIN p USING (source) WHERE d <= first + 20 AND d + 2 >= first)
SELECT job_id, partition_key, NULL AS reason FROM met WHERE max_tasks IS NULL OR k <= max_tasks
UNION ALL SELECT job_id, NULL, CASE WHEN source IN (SELECT source FROM p) THEN 'outside_window' ELSE 'no_partitions' END FROM r WHERE job_id NOT IN (SELECT job_id FROM met)""",
)(_planned)
over_tables("metric_histogram", 'WITH r AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT name, max(n) AS count, round(sum(value), 4) AS "sum", min(value) AS "min", max(value) AS "max", min(value) FILTER (WHERE k >= 0.5 * n) AS p50, min(value) FILTER (WHERE k >= 0.95 * n) AS p95 FROM r GROUP BY 1')(
    lambda spark, d: operations.histogram(table(spark, d, "events").filter("value IS NOT NULL").select(F.col("event_type").alias("name"), "value")).withColumn("sum", F.round("sum", 4))
)
_PROFILE = jobs.Profile(titles=["urgent"], skills=["low", "specified"], locations=["priority 3"], exclude=["medium"])


def _job_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    source = F.when(k % 4 == 0, "linkedin").when(k % 4 == 1, "ats").when(k % 4 == 2, "remotive").otherwise("unknown")
    return o.select(k.alias("position"), F.concat(F.lit("Job "), F.regexp_replace("o_orderpriority", "^[0-9]-", "")).alias("title"), F.lit("c").alias("company"), F.concat(F.lit("priority "), F.substring("o_orderpriority", 1, 1)).alias("location"), F.array().cast("array<string>").alias("tags"), F.concat(F.lit("about "), F.lower("o_orderstatus"), F.lit(" low")).alias("description"), F.lit("").alias("salary"), (k % 5 == 0).alias("remote"), source.alias("source"), F.col("o_orderdate").alias("published_at"), F.concat(F.lit("u"), k.cast("string")).alias("url"))


_JOB_SCORE = """WITH j AS (SELECT o_orderkey AS position, lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS t, substr(o_orderpriority, 1, 1) AS place, o_orderkey % 5 = 0 AS remote, CASE o_orderkey % 4 WHEN 0 THEN 4.0 WHEN 1 THEN 3.5 WHEN 2 THEN 2.0 ELSE 0.0 END AS trust, CASE o_orderkey % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'ats' WHEN 2 THEN 'remotive' ELSE 'unknown' END AS source, o_orderdate, greatest(0.0, (epoch(TIMESTAMP '1998-06-01 00:00:00') - epoch(o_orderdate)) / 3600) AS hours FROM orders),
s AS (SELECT position, source, o_orderdate, round(CASE WHEN t = 'medium' THEN -25.0 ELSE 0.0 END + CASE WHEN t = 'urgent' THEN 15.0 ELSE 0.0 END + CASE WHEN t = 'low' THEN 12.0 WHEN t = 'not specified' THEN 12.0 ELSE 0.0 END + 4.0
  + CASE WHEN place = '3' THEN 14.0 WHEN remote THEN 6.0 ELSE -8.0 END + CASE WHEN hours >= 336 THEN -least(6.0, (hours - 336) / 168 * 6) ELSE 12 * (1 - hours / 336) END + trust, 2) AS score FROM j)"""
over_tables("jobs_scored", f"{_JOB_SCORE} SELECT position, score FROM s")(lambda spark, d: jobs.scored(_job_rows(spark, d), _PROFILE, ntz("1998-06-01 00:00:00")).select("position", "score"))
over_tables(
    "jobs_ranked",
    f"""{_JOB_SCORE}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, o_orderdate DESC NULLS LAST, 'u' || position) AS p FROM s WHERE score > -15),
t AS (SELECT *, CASE WHEN source = 'linkedin' AND p <= 12 THEN 0 WHEN source = 'linkedin' THEN p - 12 ELSE p END AS turn, CASE WHEN source = 'linkedin' AND p <= 12 THEN p ELSE 0 END AS q, CASE source WHEN 'linkedin' THEN 0 WHEN 'ats' THEN 1 ELSE 2 END AS k FROM p) SELECT position, source, score FROM t ORDER BY turn, q, k, source LIMIT 40""",
)(lambda spark, d: jobs.ranked(_job_rows(spark, d), _PROFILE, ntz("1998-06-01 00:00:00")).select("position", "source", "score"))
over_tables("job_freshness", "WITH h AS (SELECT o_orderkey, greatest(0.0, (epoch(TIMESTAMP '1998-06-01 00:00:00') - epoch(o_orderdate)) / 3600) AS hours FROM orders) SELECT o_orderkey, round(CASE WHEN hours >= 336 THEN -least(6.0, (hours - 336) / 168 * 6) ELSE 12 * (1 - hours / 336) END, 4) + 0.0 AS points FROM h")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", (F.round(jobs.freshness(F.col("o_orderdate"), ntz("1998-06-01 00:00:00")), 4) + 0.0).alias("points"))
)

# ---- lookups, identity, text -----------------------------------------------------------------------------------------------

over_captures("capture_detail", "SELECT 'cap-2' AS capture_id, count(*) - 1 AS related_count FROM captures WHERE parent_doc_or_dup_group = (SELECT parent_doc_or_dup_group FROM captures WHERE capture_id = 'cap-2')")(lambda df: briefing.detail(df, "cap-2").select("capture_id", "related_count"))
registry.GROUPED |= {"capture_detail"}
over_captures("captures_health", "SELECT count(*) AS captures, CAST(epoch(max(fetch_ts)) AS BIGINT) AS newest, count(*) FILTER (WHERE text IS NULL) AS without_text FROM captures")(lambda df: briefing.health(df).withColumn("newest", F.unix_seconds(F.col("newest").cast("timestamp"))))
over_captures("sampled_captures", "SELECT 100 AS n, 100 AS known FROM (SELECT 1)")(lambda df: catalog.sampled(df.select("capture_id"), 100, 3).withColumn("hit", F.lit(1)).join(df.select("capture_id").distinct(), "capture_id").agg(F.count("*").alias("n"), F.count_distinct("capture_id").alias("known")))
over_captures("saved_search", "SELECT capture_id FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY fetch_ts DESC, capture_id) AS rn FROM captures WHERE title ILIKE '%theand%' OR text ILIKE '%theand%') WHERE rn = 1 ORDER BY fetch_ts DESC, capture_id LIMIT 30")(
    lambda df: briefing.run_saved(df, df.sparkSession.createDataFrame([("mine", "theand", "substring")], "name string, query string, mode string"), "mine").rows.select("capture_id")
)
over_tables("simulated_messages", "SELECT 's-7-' || k AS tweet_id, CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') + k * 37 * 60 AS BIGINT) AS created FROM (SELECT unnest(generate_series(0, 49)) AS k)")(lambda spark, d: briefing.simulated_messages(spark, "s", 50, 7).select("tweet_id", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("created")))
_POP = "sum(bit_count(xor(instr('0123456789abcdef', substr(a.signature, CAST(i AS INTEGER), 1)) - 1, instr('0123456789abcdef', substr(b.signature, CAST(i AS INTEGER), 1)) - 1)))"
over_captures("dedup_check", f"{registry._SIGS} SELECT a.capture_id, CAST({_POP} AS INTEGER) AS distance FROM sig a CROSS JOIN (SELECT signature FROM sig WHERE capture_id = 'cap-2') b CROSS JOIN (SELECT unnest(generate_series(1, 32)) AS i) GROUP BY 1 HAVING {_POP} <= 32")(lambda df: briefing.dedup_check(df, df.filter("capture_id = 'cap-2'").first()["text"]))
over_captures("weighted_signatures")(lambda df: dedup.weighted_signatures(df, key="capture_id"))
over_captures("xxh3_identities")(lambda df: df.select("capture_id", dedup.content_hash_xxh3(F.col("text")).alias("hash"), dedup.doc_id_xxh3(F.col("url"), F.col("content_hash")).alias("doc"), dedup.capture_id_xxh3(F.col("doc_id"), F.col("domain"), F.col("url")).alias("capture")))
over_captures("weighted_near_decisions")(lambda df: dedup.near_decisions(df, weighted=True))


def _guards(df: DataFrame) -> DataFrame:
    s = df.select("capture_id", "doc_id", dedup.token_sketch(F.col("text")).alias("s")).select("capture_id", "doc_id", "s.*")
    other = s.select(F.col("capture_id").alias("other"), F.col("token_hash").alias("h"), F.col("token_count").alias("c"))
    both = s.join(other, F.concat(F.lit("cap-"), (F.col("doc_id").cast("long") + 1).cast("string")) == F.col("other"))
    return both.select("capture_id", dedup.guard_allows(F.col("token_hash"), F.col("token_count"), F.col("h"), F.col("c")).alias("allowed"))


_SKETCH = registry.oracle_sql()["token_sketches"]
over_tables("merge_guards", f"WITH s AS (SELECT *, CAST(substr(capture_id, 5) AS BIGINT) AS k FROM ({_SKETCH})) SELECT a.capture_id, coalesce(abs(a.token_count - b.token_count) / greatest(a.token_count, b.token_count) <= 0.5 AND (a.token_count > 200 OR b.token_count > 200 OR a.token_hash = b.token_hash), true) AS allowed FROM s a JOIN s b ON b.k = a.k + 1")(lambda spark, d: _guards(captures(spark, d, False)))
_XOR = "sum(bit_count(xor(instr('0123456789abcdef', substr(x.signature, CAST(i AS INTEGER), 1)) - 1, instr('0123456789abcdef', substr(y.signature, CAST(i AS INTEGER), 1)) - 1)))"
_DECIDED = f"""{registry._SIGS}, ex AS ({registry.oracle_sql()["exact_decisions"].partition("documents d)")[2]}), sk AS ({_SKETCH}),
nu AS (SELECT c.capture_id, c.doc_id, c.observed_ts AS seen_at, signature, token_hash, token_count FROM captures c JOIN ex ON ex.capture_id = c.capture_id LEFT JOIN sig ON sig.capture_id = c.capture_id LEFT JOIN sk ON sk.capture_id = c.capture_id WHERE decision = 'NEW'),
cand AS (SELECT a.capture_id AS a, b.capture_id AS b FROM nu a JOIN nu b ON (b.seen_at < a.seen_at OR b.seen_at = a.seen_at AND b.capture_id < a.capture_id) WHERE a.signature IS NOT NULL AND b.signature IS NOT NULL),
dist AS (SELECT a, b, CAST({_XOR} AS INTEGER) AS d FROM cand JOIN nu x ON x.capture_id = a JOIN nu y ON y.capture_id = b CROSS JOIN (SELECT unnest(generate_series(1, 32)) AS i) GROUP BY a, b),
best AS (SELECT a, b, d FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, y.seen_at, b) AS rn FROM dist JOIN nu y ON y.capture_id = b) WHERE rn = 1 AND d <= 32),
parent AS (SELECT a, b, d FROM best JOIN nu x ON x.capture_id = a JOIN nu y ON y.capture_id = b WHERE coalesce(abs(x.token_count - y.token_count) / greatest(x.token_count, y.token_count) <= 0.5 AND (x.token_count > 200 OR y.token_count > 200 OR x.token_hash = y.token_hash), true)),
up AS (SELECT capture_id, doc_id, doc_id AS top FROM nu WHERE capture_id NOT IN (SELECT a FROM parent) UNION ALL SELECT n.capture_id, n.doc_id, up.top FROM parent p JOIN up ON up.capture_id = p.b JOIN nu n ON n.capture_id = p.a),
near AS (SELECT ex.capture_id, CASE WHEN decision = 'NEW' AND d IS NOT NULL THEN 'NEAR_DUP' ELSE decision END AS decision, coalesce(top, fd) AS dup_group, d AS distance
  FROM (SELECT capture_id, decision, first_doc AS fd FROM ex) ex LEFT JOIN parent ON a = ex.capture_id LEFT JOIN (SELECT doc_id, min(top) AS top FROM up GROUP BY 1) t ON t.doc_id = fd)"""
_RECURSIVE = CAPTURES_SQL.replace("captures AS", "RECURSIVE captures AS", 1)
over_tables("near_decisions", f"WITH {_RECURSIVE}{_DECIDED} SELECT capture_id, decision, dup_group, coalesce(distance, -1) AS distance FROM near")(lambda spark, d: dedup.near_decisions(captures(spark, d, False)).fillna(-1, ["distance"]))
over_tables("stored_captures", f"WITH {_RECURSIVE}{_DECIDED} SELECT capture_id, decision, dup_group, coalesce(distance, -1) AS distance FROM near WHERE decision NOT IN ('EXACT_DUP', 'REVISION') AND NOT (decision = 'NEAR_DUP' AND distance <= 12)")(lambda spark, d: dedup.stored(dedup.near_decisions(captures(spark, d, False))).fillna(-1, ["distance"]))
over_tables("false_positive_rates", "WITH k AS (SELECT unnest(generate_series(0, 16)) AS k), c AS (SELECT k, CAST(factorial(16) AS DOUBLE) / (CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST(16 - k AS INTEGER)) AS DOUBLE)) / 65536.0 AS p FROM k) SELECT CAST(k AS INTEGER) AS threshold, round(sum(p) OVER (ORDER BY k), 9) AS rate FROM c")(
    lambda spark, d: spark.createDataFrame([(t, round(dedup.false_positive_rate(16, t), 9)) for t in range(17)], "threshold int, rate double")
)
over_tables("calibrated_thresholds", "WITH k AS (SELECT unnest(generate_series(0, 16)) AS k), c AS (SELECT k, CAST(factorial(16) AS DOUBLE) / (CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST(16 - k AS INTEGER)) AS DOUBLE)) / 65536.0 AS p FROM k), r AS (SELECT k, sum(p) OVER (ORDER BY k) AS rate FROM c) SELECT CAST(t.rate AS DOUBLE) AS rate, CAST(coalesce(max(k), -1) AS INTEGER) AS threshold FROM (VALUES (0.5), (0.1), (0.01), (0.000001)) t(rate) LEFT JOIN r ON r.rate <= t.rate GROUP BY 1")(
    lambda spark, d: spark.createDataFrame([(x, dedup.calibrated_threshold(16, x)) for x in (0.5, 0.1, 0.01, 0.000001)], "rate double, threshold int")
)
_GATES = registry.oracle_sql()["gate_reasons"]
over_tables("gates_for_languages", f"SELECT capture_id, CASE WHEN lang IS NULL OR lower(lang) LIKE 'en%' THEN reason END AS reason FROM ({_GATES}) JOIN (SELECT 'cap-' || CAST(doc_id AS VARCHAR) AS capture_id, lang FROM documents) USING (capture_id)")(lambda spark, d: captures(spark, d, False).select("capture_id", texts.gate_for_language(F.col("text"), F.col("language")).alias("reason")))
over_captures("language_tags", "SELECT capture_id, nullif(array_to_string(list_filter(string_split(lower(replace(language || '__' || upper(domain) || '--x', '_', '-')), '-'), lambda x: x <> ''), '-'), '') AS tag FROM captures")(lambda df: df.select("capture_id", texts.language_tag(F.concat("language", F.lit("__"), F.upper("domain"), F.lit("--x"))).alias("tag")))
over_captures("topic_filter", r"SELECT capture_id FROM captures WHERE regexp_matches(concat_ws(chr(10), title, text), '(?i)(^|[^\pL\pM\pN_])the($|[^\pL\pM\pN_])') OR regexp_matches(concat_ws(chr(10), title, text), '(?i)(^|[^\pL\pM\pN_])c\+\+')")(lambda df: df.filter(texts.TopicFilter.from_config({"terms": ["the", " c++ ", ""], "mode": "any"}).column()).select("capture_id"))
_TRIMMED = rf"regexp_replace({registry._CLEAN}, '^\s+|\s+$', '', 'g')"
over_captures("normalized", rf", n AS (SELECT capture_id, {_TRIMMED} AS c FROM captures) SELECT capture_id, length(c) AS n_chars, len(list_filter(str_split_regex(c, '\s+'), lambda w: w <> '')) AS n_words, CASE WHEN length(c) > 0 THEN len(string_split(c, chr(10))) ELSE 0 END AS n_lines, CASE WHEN length(c) < 200 THEN 'too_short' WHEN length(c) > 1500000 THEN 'too_long' END AS discard FROM n")(lambda df: texts.normalized(df).select("capture_id", "n_chars", "n_words", "n_lines", "discard"))
over_captures("length_floors", "SELECT capture_id, CASE WHEN length(text) >= CASE WHEN channel LIKE 'rss%' OR channel LIKE 'sitemap%' THEN 80 ELSE 200 END THEN 1 ELSE 0 END AS kept FROM (SELECT *, CASE CAST(doc_id AS BIGINT) % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'sitemap_news' ELSE 'bulk' END AS channel FROM captures)")(
    lambda df: df.select("capture_id", (F.length("text") >= texts.min_chars_for(F.when(F.col("doc_id").cast("long") % 3 == 0, "rss").when(F.col("doc_id").cast("long") % 3 == 1, "sitemap_news").otherwise("bulk"))).cast("int").alias("kept"))
)
over_captures("dataset_rows", "SELECT capture_id FROM captures WHERE length(text) >= 200 AND language IN ('en', 'fr') AND domain IN ('src1.example', 'src2.example') AND CAST(doc_id AS BIGINT) >= 100")(
    lambda df: web.dataset_rows(df.drop("domain").withColumn("position", F.col("doc_id").cast("long")), ["en", "fr"], ["src1.example", "src2.example"], 200, 100).select("capture_id")
)
over_captures(
    "domain_profile",
    f""", p AS (SELECT * FROM captures WHERE domain = 'src3.example'),
l AS (SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, k) AS languages FROM (SELECT split_part(lower(language), '-', 1) AS k, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, k LIMIT 10)),
y AS (SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, k) AS source_types FROM (SELECT source_type AS k, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, k LIMIT 20)),
w AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM p) WHERE length(term) >= 3 AND term NOT IN ({sql_words(SOURCE_STOPWORDS)}) AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY 1 ORDER BY n DESC, term LIMIT 20),
t AS (SELECT string_agg(term || ':' || n, ',' ORDER BY n DESC, term) AS terms FROM w)
SELECT 'src3.example' AS domain, count(*) AS captures, round(avg(length(text)), 1) AS avg_length, CAST(min(observed_ts) AS DATE) AS first_seen, CAST(max(observed_ts) AS DATE) AS last_seen,
  round(count(*) FILTER (WHERE observed_ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}') / 30.0, 4) AS velocity, any_value(languages) AS languages, any_value(source_types) AS source_types, any_value(terms) AS terms FROM p CROSS JOIN l CROSS JOIN y CROSS JOIN t""",
)(lambda df: sources.domain_profile(df, "src3.example", as_of()))
_DROPPED = ", ".join(f"'{t}'" for t in ["the", *registry._QUERY])
over_captures("dropped_terms", f"{registry._POST}, f AS (SELECT term, count(*) AS df FROM post WHERE term IN ({_DROPPED}) GROUP BY 1), i AS (SELECT *, ln(1 + ((SELECT count(*) FROM captures) - df + 0.5) / (df + 0.5)) AS idf, (SELECT count(*) FROM captures) AS docs FROM f), g AS (SELECT *, idf < 1.0 AND docs >= 20 AS low FROM i) SELECT term, df, round(idf, 6) AS idf, low AND NOT bool_and(low) OVER () AS dropped FROM g")(lambda df: search.dropped_terms(df, ["the", *registry._QUERY], search.postings(df)))



def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """An index that is built, appended to, promoted and appended to again; what it then knows of some terms."""
    df, third = captures(spark, d, False), F.col("doc_id").cast("long") % 3
    index = search.SearchIndex(spark, shared_subdir(spark, "index")).build(df.filter(third == 0), 8)
    old = ntz("2024-01-01 00:00:00")
    if index.append(df.filter(third <= 1), old).due(as_of()):
        index.promote()
    index.append(df, old)
    found = search.document_frequencies(index.of_terms(["the", *registry._QUERY]))
    return found.crossJoin(F.broadcast(index.stats())).select("term", "df", "docs", F.round("avg_title", 4).alias("avg_title"), F.round("avg_text", 4).alias("avg_text"), F.lit(index.missing(df).count()).alias("missing"))


over_tables("index_lifecycle", f"WITH {CAPTURES_SQL}{registry._POST} SELECT term, count(*) AS df, (SELECT count(*) FROM captures) AS docs, (SELECT round(greatest(1.0, avg(length(title))), 4) FROM captures) AS avg_title, (SELECT round(greatest(1.0, avg(length(text))), 4) FROM captures) AS avg_text, 0 AS missing FROM post WHERE term IN ({_DROPPED}) GROUP BY term")(_indexed)

# ---- re-ranking ------------------------------------------------------------------------------------------------------------


def _factors(source: str, terms: list[str], keep: str) -> str:
    """factors: the columns keep of source, and each re-ranking factor's fraction over its title, text, url and domain."""
    n, wanted = len(terms), "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    words = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[A-Za-z0-9'']+'), lambda t: length(t) >= 2)"
    hit = lambda x: "(" + " + ".join(f"CAST(contains({x}, '{t}') AS INTEGER)" for t in terms) + f") / {float(n)}"
    phrase = lambda x: f"CASE WHEN contains({x}, '{' '.join(terms)}') THEN 1.0 WHEN regexp_matches({x}, '(?s){'.*?'.join(terms)}') THEN 0.5 ELSE 0.0 END"
    exact, prefix = lambda x: f"CAST({x} = {wanted} AS DOUBLE)", lambda x: f"CAST({x}[1:{n}] = {wanted} AS DOUBLE)"
    return f"""low AS (SELECT *, lower(coalesce(title, '')) AS ti, lower(substr(coalesce(text, ''), 1, 280)) AS le, lower(domain) || ' ' || lower(url) AS wh, regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*|[?#].*$', '', 'g') AS path FROM {source}),
leaf AS (SELECT *, trim(regexp_replace(wh, '[^a-z0-9'']+', ' ', 'g')) AS bl, regexp_replace(regexp_extract(path, '([^/]+)/*$', 1), '(.)[.](html|htm|php|aspx)$', '\\1') AS slug FROM low),
lists AS (SELECT *, {words('ti')} AS tt, {words('le')} AS lt, {words('slug')} AS st, regexp_extract_all(lower(domain), '[a-z0-9]+') AS labels FROM leaf),
factors AS (SELECT {keep}, {hit('ti')} AS title_hit, {phrase('ti')} AS title_phrase, {exact('tt')} AS title_exact, {prefix('tt')} AS title_prefix, {hit('wh')} AS url_hit, {phrase('bl')} AS url_phrase, {exact('st')} AS url_exact, {prefix('st')} AS url_prefix,
  len(list_filter({wanted}, lambda t: list_contains(labels, t))) / {float(n)} AS domain_nav, {hit('le')} AS lead_hit, {phrase('le')} AS lead_phrase, {prefix('lt')} AS lead_prefix, {exact('lt')} AS lead_exact,
  CASE WHEN length(coalesce(text, '')) <= 4000 THEN 1.0 ELSE 0.75 + 0.25 * 4000 / length(text) END AS length_factor FROM lists)"""


_PRODUCT = " * ".join(f"(1 + {v} * {k})" for k, v in search.BOOSTS.items())
over_captures(
    "reranked_search",
    f"{registry._BM25}, top AS (SELECT c.*, round(score, 9) AS score FROM captures c JOIN scored USING (capture_id) ORDER BY round(score, 9) DESC, capture_id LIMIT 200), {_factors('top', ['theand', 'of'], 'capture_id, score')} SELECT capture_id, round(score / max(score) OVER () * {_PRODUCT} * length_factor, 6) AS final_score FROM factors",
)(lambda df: search.reranked(df.join(search.bm25f(df, registry._QUERY), "capture_id").orderBy(F.desc("score"), "capture_id").limit(200), ["theand", "of"]).select("capture_id", F.round("final_score", 6).alias("final_score")))
_TWO = registry._BM25.replace(", ".join(f"'{t}'" for t in registry._QUERY), "'theand', 'of'")
over_captures(
    "search_results",
    f"""{_TWO}, top AS (SELECT c.*, round(score, 9) AS score FROM captures c JOIN scored USING (capture_id) ORDER BY round(score, 9) DESC, capture_id LIMIT 200), {_factors('top', ['theand', 'of'], 'capture_id, score, parent_doc_or_dup_group AS grp')},
f AS (SELECT capture_id, grp, score, round(score / max(score) OVER () * {_PRODUCT} * length_factor, 9) AS final_score FROM factors), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY final_score DESC, score DESC, capture_id) AS rn FROM f)
SELECT capture_id, round(final_score, 6) AS final_score FROM r WHERE rn = 1 ORDER BY r.final_score DESC, score DESC, capture_id LIMIT 30""",
)(lambda df: search.search(df, "theand of", prune=False).rows.select("capture_id", F.round("final_score", 6).alias("final_score")))
registry.GROUPED |= {"search_results"}
_SAYS = {
    "title": ["Bitcoin price", "Bitcoin Price surges", "The price of bitcoin", "bitcoin and the price", "Other"],
    "text": ["Bitcoin price", "bitcoin price rises today", "on bitcoin, its price", "nothing"],
    "url": ["https://bitcoin.example/a/bitcoin-price.html?x=1", "https://price.example/bitcoin-price-news/", "https://e.example/x/y"],
    "domain": ["bitcoin.example", "price.example", "e.example"],
}
_SAYS_SQL = ", ".join(f"{says}[CAST(CAST(doc_id AS BIGINT) % {len(says)} AS INTEGER) + 1] AS {c}" for c, says in _SAYS.items())


def _with_says(df: DataFrame) -> DataFrame:
    k = F.col("doc_id").cast("long")
    return df.withColumns({c: F.get(F.array(*[F.lit(x) for x in says]), (k % len(says)).cast("int")) for c, says in _SAYS.items()})


over_captures("rerank_factors", f", said AS (SELECT capture_id, fetch_ts, {_SAYS_SQL} FROM captures), {_factors('said', ['bitcoin', 'price'], 'capture_id, fetch_ts')} SELECT * EXCLUDE (fetch_ts), round(1 + 0.5 * pow(0.5, (epoch(TIMESTAMP '{AS_OF}') - epoch(fetch_ts)) / 86400 / 30), 6) AS recency FROM factors")(
    lambda df: _with_says(df).select("capture_id", *[c.alias(n) for n, c in search.rerank_factors(["bitcoin", "price"]).items()], search.length_factor(F.col("text")).alias("length_factor"), F.round(search.recency_factor(F.col("fetch_ts"), as_of(), 0.5), 6).alias("recency"))
)

# ---- entities --------------------------------------------------------------------------------------------------------------


def _entities(where: str) -> str:
    """ents: capture_id, entity, kind, by the rules of operators/entities.py, of the captures that where holds for."""
    starters, suffixes, places, nouns = (sql_words(x) for x in (entities.STARTERS, entities.ORG_SUFFIXES, entities.PLACES, entities.HEADLINE_NOUNS))
    return f"""docs AS (SELECT capture_id, title || chr(10) || text AS t FROM captures WHERE {where}),
tok AS (SELECT capture_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM (SELECT capture_id, regexp_extract_all(t, '[A-Za-z][A-Za-z0-9''&.-]*') AS w FROM docs) WHERE len(w) > 0),
tc AS (SELECT capture_id, w, p, p - row_number() OVER (PARTITION BY capture_id ORDER BY p) AS g FROM tok WHERE regexp_full_match(w, '[A-Z][A-Za-z]*')),
sp AS (SELECT * FROM (SELECT capture_id, g, w, row_number() OVER (PARTITION BY capture_id, g ORDER BY p) AS k, w IN ({suffixes}) AS sfx FROM tc) WHERE k <= 8),
near AS (SELECT *, coalesce(max(CASE WHEN sfx THEN k END) OVER (PARTITION BY capture_id, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev, bool_or(sfx) OVER (PARTITION BY capture_id, g) AS any_sfx, count(*) OVER (PARTITION BY capture_id, g) AS n FROM sp),
orgs AS (SELECT s.capture_id, concat_ws(' ', (SELECT string_agg(w, ' ' ORDER BY k) FROM (SELECT w, k FROM sp b WHERE b.capture_id = s.capture_id AND b.g = s.g AND b.k > s.prev AND b.k < s.k AND b.w NOT IN ({starters}) ORDER BY k DESC LIMIT 3)), s.w) AS entity FROM near s WHERE sfx),
parts AS (SELECT a.capture_id, a.g, a.k, z.size, string_agg(b.w, ' ' ORDER BY b.k) AS entity FROM near a CROSS JOIN (VALUES (1), (2), (3), (4)) z(size) JOIN sp b ON b.capture_id = a.capture_id AND b.g = a.g AND b.k BETWEEN a.k - z.size + 1 AND a.k WHERE NOT a.sfx AND a.k - z.size >= a.prev GROUP BY ALL),
found AS (SELECT capture_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, g, k ORDER BY size) AS rn FROM parts WHERE entity IN ({places})) WHERE rn = 1),
people AS (SELECT capture_id, max(w) FILTER (WHERE k = 1) || ' ' || max(CASE WHEN lower(w) IN ('and', 'of', 'the', 'for', 'in', 'on', 'at', 'to', 'vs') THEN lower(w) ELSE w END) FILTER (WHERE k = 2) AS entity FROM near WHERE NOT any_sfx AND n BETWEEN 2 AND 3 GROUP BY capture_id, g HAVING bool_and(w NOT IN ({nouns}) AND w NOT IN ({places})) AND max(w) FILTER (WHERE k = 1) NOT IN ({starters})),
tickers AS (SELECT capture_id, x AS entity FROM docs CROSS JOIN (SELECT unnest([{sql_words(entities.TICKERS)}]) AS x) WHERE contains(upper(t), x) AND regexp_matches(t, '(?i)(^|[^A-Za-z0-9$])[$]?' || x || '($|[^A-Za-z0-9])')),
every AS (SELECT DISTINCT * FROM (SELECT capture_id, entity, 'ORG' AS kind FROM orgs UNION ALL SELECT capture_id, entity, 'PLACE' FROM found UNION ALL SELECT capture_id, entity, 'PERSON' FROM people)),
ents AS (SELECT * FROM every WHERE length(entity) BETWEEN 2 AND 80 AND lower(entity) NOT IN ('the', 'a', 'an', 'this', 'that', 'these', 'new', 'old', 'big', 'high', 'low') UNION ALL SELECT capture_id, entity, 'TICKER' FROM tickers)"""


over_captures("entity_counts", f", {_entities(chr(39) + 'x' + chr(39) + ' = ' + chr(39) + 'x' + chr(39))} SELECT entity, kind, count(*) AS count FROM ents GROUP BY 1, 2 ORDER BY count DESC, entity, kind LIMIT 100")(lambda df: entities.entity_counts(df))
over_captures("entity_co_occurrence", f", {_entities(registry._has('The'))} SELECT entity, kind, count(*) AS count FROM ents WHERE lower(entity) <> 'the' GROUP BY 1, 2 ORDER BY count DESC, entity, kind LIMIT 50")(lambda df: entities.co_occurrence(df, "The"))


def _with_names(df: DataFrame) -> DataFrame:
    """Captures with sentences that name things of every kind, by their number."""
    said = ["Angela Smith met the First National Bank of Ankara in New York", "Shares of $NVDA and btc rose, said The Old River Trust Company News", "Bitcoin Rally Today", "United Kingdom Ministry Board", "Rio de Janeiro, Los Angeles; Mexico City Council", "Jean Of Arc Jones", "XBTC $$ETH AT&T Inc"]
    k = F.col("doc_id").cast("long")
    return df.withColumn("text", F.concat(F.get(F.array(*[F.lit(x) for x in said]), (k % len(said)).cast("int")), F.lit(". x "), F.get(F.array(*[F.lit(x) for x in said]), (k % 3).cast("int"))))


_SAID = "['Angela Smith met the First National Bank of Ankara in New York', 'Shares of $NVDA and btc rose, said The Old River Trust Company News', 'Bitcoin Rally Today', 'United Kingdom Ministry Board', 'Rio de Janeiro, Los Angeles; Mexico City Council', 'Jean Of Arc Jones', 'XBTC $$ETH AT&T Inc']"
_NAMED = CAPTURES_SQL.replace("d.text AS text, d.lang", f"{_SAID}[CAST(d.doc_id % 7 AS INTEGER) + 1] || '. x ' || {_SAID}[CAST(d.doc_id % 3 AS INTEGER) + 1] AS text, d.lang")
over_tables("entity_kinds", f"WITH {_NAMED}, {_entities('true')} SELECT entity, kind, count(*) AS count FROM ents GROUP BY 1, 2 ORDER BY count DESC, entity, kind LIMIT 100")(lambda spark, d: entities.entity_counts(_with_names(captures(spark, d, False))))

# ---- URLs ------------------------------------------------------------------------------------------------------------------

_URLS = "u AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://' || source || '.example/' WHEN 1 THEN 'https://' || source || '.example/index.html' WHEN 2 THEN 'http://localhost/' || doc_id WHEN 3 THEN 'https://10.0.0.' || doc_id % 200 || '/x' ELSE 'https://www.' || source || '.co.uk/a?b=' || doc_id END AS url, source FROM documents)"


def _urls(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("doc_id"), F.col("source")
    said = F.when(k % 5 == 0, F.concat(F.lit("https://"), s, F.lit(".example/"))).when(k % 5 == 1, F.concat(F.lit("https://"), s, F.lit(".example/index.html"))).when(k % 5 == 2, F.concat(F.lit("http://localhost/"), k.cast("string")))
    said = said.when(k % 5 == 3, F.concat(F.lit("https://10.0.0."), (k % 200).cast("string"), F.lit("/x"))).otherwise(F.concat(F.lit("https://www."), s, F.lit(".co.uk/a?b="), k.cast("string")))
    return table(spark, d, "documents").select("doc_id", said.alias("url"), "source")


over_tables("homepages", f"WITH {_URLS} SELECT doc_id, doc_id % 5 < 2 AS homepage, doc_id % 5 NOT IN (2, 3) AS public, CASE doc_id % 5 WHEN 0 THEN source || '.example' WHEN 1 THEN source || '.example' WHEN 2 THEN 'localhost' WHEN 3 THEN '10.0.0.' || doc_id % 200 ELSE source || '.co.uk' END AS site FROM u")(lambda spark, d: _urls(spark, d).select("doc_id", urls.homepage_column("url").alias("homepage"), urls.public_column("url").alias("public"), urls.domain_column("url").alias("site")))
over_tables("robots_decisions", "SELECT doc_id, doc_id % 2 = 1 AS allowed FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", urls.robots_column(F.concat(F.lit("User-agent: *\nDisallow: /private/\nCrawl-delay: "), (F.col("doc_id") % 3).cast("string")), F.concat(F.lit("https://e.example/"), F.when(F.col("doc_id") % 2 == 0, "private/").otherwise("open/"), F.col("doc_id").cast("string"))).alias("allowed"))
)
over_tables("robots_sitemaps", "SELECT doc_id, 'https://e.example/' || doc_id || '.xml,https://e.example/all.xml' AS sitemaps FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.array_join(urls.sitemap_urls(F.concat(F.lit("User-agent: *\r\nSitemap: https://e.example/"), F.col("doc_id").cast("string"), F.lit(".xml\n sitemap : https://e.example/all.xml\nSITEMAP:https://e.example/all.xml\nsitemap:\n"))), ",").alias("sitemaps"))
)


def _list_of(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _unescaped(said: str) -> str:
    """SQL of a text with its character references resolved as HTML has it (html.unescape): all names; old ones without their semicolon too,
    the longest that fits; numbers, of which those from 128 to 159 mean other characters and some none."""
    shorts = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
    others = {n: unescape(f"&#{n};") for n in (0, 13, *range(128, 160))}
    number = "coalesce(TRY_CAST(CASE WHEN r[3] IN ('x', 'X') THEN '0x' || regexp_extract(r, '^&#.0*([0-9a-fA-F]+)', 1) ELSE regexp_extract(r, '[0-9]+') END AS BIGINT), 9999999)"
    of_number = f"""list_transform([{number}], lambda n: CASE WHEN list_contains({list(others)}, n) THEN {_list_of(others.values())}[list_position({list(others)}, n)]
 WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(CAST(n AS INTEGER)) END)[1]"""
    name = lambda x: f"map({_list_of(html5)}, {_list_of(html5.values())})[{x}]"
    short = f"regexp_extract(r, '^&({shorts})', 1)"
    common = " ".join(f"WHEN '&{n};' THEN '{c}'" for n, c in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')))  # are in the list as well, but soon found here
    one = f"""CASE r {common} ELSE CASE WHEN r[1] <> '&' OR r = '&' THEN r WHEN r[2] = '#' THEN {of_number}
 ELSE coalesce({name("r[2:]")}, CASE WHEN {short} <> '' THEN {name(short)} || r[length({short}) + 2:] ELSE r END) END END"""
    return rf"coalesce(array_to_string(list_transform(regexp_extract_all({said}, '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{{1,32}};?|&|[^&]+'), lambda r: {one}), ''), '')"


#: White space of all kinds as one blank.
_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"
_TITLE = _unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
over_tables("html_titles", rf"SELECT page_id, trim(regexp_replace({_TITLE}, '{_BLANKS}', ' ', 'g')) AS title, nullif(regexp_extract(html, '(?is)<html[^>]*?[ ]lang=.([a-zA-Z-]+)', 1), '') AS language FROM pages")(lambda spark, d: html.html_to_text(table(spark, d, "pages")).select("page_id", "title", "language"))

_MAIN = _unescaped(r"regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g')")
over_tables("main_texts", rf"SELECT page_id, trim(regexp_replace({_MAIN}, '{_BLANKS}', ' ', 'g')) AS text, nullif(regexp_extract(html, '(?is)<html[^>]*?[ ]lang=.([a-zA-Z-]+)', 1), '') AS language FROM pages")(
    lambda spark, d: maintext.with_main_text(table(spark, d, "pages")).select("page_id", F.trim(F.regexp_replace("page.text", r"\s+", " ")).alias("text"), "page.language")
)

# ---- round trips through files -----------------------------------------------------------------------------------------------


def _stored_captures(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_subdir(spark, "captures")
    rows = captures(spark, d, False)
    digest.write_captures(rows.filter("source_type <> 'src1'"), folder)
    digest.write_captures(rows.filter("source_type = 'src1'"), folder)
    return jsonl.read_captures(spark, folder).select("capture_id", "source_type", F.to_date("fetch_day").alias("fetch_day"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


over_tables("stored_table", f"WITH {CAPTURES_SQL} SELECT capture_id, source_type, CAST(fetch_ts AS DATE) AS fetch_day, md5(text) AS text_md5 FROM captures")(_stored_captures)


def _json_folder(spark: SparkSession, d: str) -> str:
    """Captures as JSON lines by day and source, with times of nine decimals, a torn line, and a file that is still being written."""
    rows = captures(spark, d, False).withColumn("fetch_ts", F.concat(F.date_format("fetch_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456789Z")))
    lines = rows.select(F.to_json(F.struct("capture_id", "doc_id", "domain", "fetch_ts", "text", F.lit("12x").alias("http_status"))).alias("value"), F.to_date("fetch_ts").alias("fetch_day"))
    torn = rows.filter("doc_id = '2'").select(F.lit('{"capture_id": "torn", "te').alias("value"), F.to_date("fetch_ts").alias("fetch_day"))
    folder = write_lines(lines.union(torn).select("value"), "jsonl")
    files = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, status in enumerate(fs.listStatus(files)):
        path = status.getPath()
        if path.getName().startswith("part-"):
            day = spark._jvm.org.apache.hadoop.fs.Path(files, f"fetch_day=2024-01-{k % 28 + 1:02}")
            fs.mkdirs(day)
            fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(day, f"{k}.jsonl"))
    lines.limit(1).select("value").write.text(folder + "/fetch_day=2024-01-30/writing.jsonl.tmp")
    return folder


over_tables("jsonl_scan", f"WITH {CAPTURES_SQL} SELECT capture_id, domain, CAST(epoch(fetch_ts) * 1000000 + 123456 AS BIGINT) AS fetched, md5(text) AS text_md5, true AS unread FROM captures")(
    lambda spark, d: jsonl.read_jsonl(spark, _json_folder(spark, d)).select("capture_id", "domain", F.unix_micros("fetch_ts").alias("fetched"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.isnull("http_status").alias("unread"))
)
over_tables("bad_lines", "SELECT '{\"capture_id\": \"torn\", \"te' AS value")(lambda spark, d: jsonl.bad_records(spark, _json_folder(spark, d)).select("value"))


def _exported_texts(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_subdir(spark, "texts")
    digest.write_texts(captures(spark, d, False).select("title", F.regexp_replace("text", r"[\r\n]+", " ").alias("text")), folder)
    return spark.read.text(folder).select(F.md5(F.col("value").cast("binary")).alias("line_md5"))


over_tables("exported_texts", rf"WITH {CAPTURES_SQL}, l AS (SELECT unnest([coalesce(title, ''), regexp_replace(text, '[\r\n]+', ' ', 'g')]) AS line FROM captures) SELECT md5(line) AS line_md5 FROM l")(_exported_texts)


def _exported_csv(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_subdir(spark, "csv")
    digest.write_csv(sentiment.sentiment_series(captures(spark, d, False), OTHER, 14, lexicon=registry._LEX), folder)
    return spark.read.schema("bucket date, docs long, positive long, negative long, avg_score double").option("header", True).csv(folder)


over_tables("exported_csv", registry.oracle_sql()["sentiment_series"])(_exported_csv)


def _exported_llm(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_subdir(spark, "llm")
    digest.write_llm(captures(spark, d), folder)
    rows = spark.read.schema("instruction string, input string, output string, metadata struct<capture_id:string>").json(folder)
    return rows.select(F.md5(F.col("output").cast("binary")).alias("output_md5"), "metadata.capture_id")


over_tables("exported_llm", registry.oracle_sql()["llm_export"])(_exported_llm)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_subdir(spark, "snapshots")
    shot = quality.quality_snapshot(captures(spark, d))
    quality.record_snapshot(shot, folder, ntz("2024-01-02 00:00:00"))
    quality.record_snapshot(shot.withColumn("total_captures", F.lit(0).cast("long")), folder, ntz("2024-01-01 00:00:00"))
    spark.createDataFrame([('{"total_captures": 7, "rec',)], "value string").write.mode("append").text(folder)
    return quality.recorded_snapshots(spark, folder, "total_captures long, duplicate_ratio double").select(F.to_date("recorded_at").alias("day"), "total_captures", "duplicate_ratio")


_SHOT = registry.oracle_sql()["quality_snapshot"]
over_tables("snapshot_history", f"SELECT DATE '2024-01-02' AS day, total_captures, duplicate_ratio FROM ({_SHOT}) UNION ALL SELECT DATE '2024-01-01', 0, duplicate_ratio FROM ({_SHOT})")(_snapshots)


def _wet_folder(spark: SparkSession, d: str) -> str:
    text = F.col("text").cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: "), "url", F.lit("\r\nWARC-Date: 2024-01-05T00:00:00Z\r\nWARC-Record-ID: <urn:x:"), "doc_id", F.lit(">\r\nContent-Type: text/plain\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"))
    rows = captures(spark, d, False)
    info = F.lit("WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
    return write_lines(rows.select(F.concat(info, head, "text", F.lit("\r\n\r\n")).alias("value")), "wet")


over_tables("wet_records", f"WITH {CAPTURES_SQL} SELECT 'conversion' AS record_type, url, md5(text) AS payload_md5 FROM captures")(
    lambda spark, d: web.read_warc(spark, _wet_folder(spark, d) + "/*.txt").filter("record_type = 'conversion'").select("record_type", "url", F.md5("payload").alias("payload_md5"))
)
over_tables("wet_captures", f"WITH {CAPTURES_SQL}, c AS (SELECT url, domain, {_TRIMMED} AS clean FROM captures) SELECT url, domain, length(clean) AS n_chars FROM c WHERE length(clean) >= 200 AND domain IN ('src1.example', 'src2.example')")(
    lambda spark, d: web.wet_captures(web.read_warc(spark, _wet_folder(spark, d) + "/*.txt"), ["SRC1.example", "src2.example"], quality=False).select("url", "domain", F.length("text").alias("n_chars"))
)


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Pages as response records, with an HTTP head, read back as titles and texts."""
    html = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html><head><title>Page "), "doc_id", F.lit("</title><script>no</script></head><body><nav>menu</nav><p>One <b>two</b> &amp; "), "doc_id", F.lit("</p><p>three</p></body></html>"))
    rows = captures(spark, d, False).select("url", html.alias("h"))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: <"), "url", F.lit(">\r\nContent-Length: "), F.octet_length("h").cast("string"), F.lit("\r\n\r\n"))
    folder = write_lines(rows.select(F.concat(head, "h", F.lit("\r\n\r\n")).alias("value")), "responses")
    return web.response_captures(web.read_warc(spark, folder + "/*.txt"), 5).select("url", "title", "text")


over_tables("response_captures", f"WITH {CAPTURES_SQL} SELECT url, 'Page ' || doc_id AS title, 'One two & ' || doc_id || chr(10) || 'three' AS text FROM captures")(_responses)
over_tables("shard_paths", "SELECT 'crawl/' || doc_id || '.wet.gz' AS path FROM documents")(lambda spark, d: web.shard_paths(spark, write_lines(table(spark, d, "documents").select(F.concat(F.lit(" crawl/"), F.col("doc_id").cast("string"), F.lit(".wet.gz ")).alias("value")), "paths")).select("path"))


def _archives(spark: SparkSession, d: str) -> DataFrame:
    datasource.register(spark)
    folder = _wet_folder(spark, d)
    files = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(files):
        path = status.getPath()
        if path.getName().endswith(".txt"):
            fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(files, path.getName().removesuffix(".txt") + ".warc"))
    return spark.read.format("tidewrack_warc").load(folder).groupBy("record_type").agg(F.count("*").alias("records"), F.sum(F.octet_length("payload")).alias("bytes"))


over_tables("archive_source", "SELECT 'conversion' AS record_type, count(*) AS records, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents UNION ALL SELECT 'warcinfo', count(*), CAST(2 * count(*) AS BIGINT) FROM documents")(_archives)


def _crawls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *web.crawl_window(c)) for c in (f"CC-MAIN-2024-{w:02}" for w in range(1, 53, 4))], "id string, first date, last date")


over_tables("overlapping_crawls", "SELECT 'CC-MAIN-2024-' || lpad(CAST(w AS VARCHAR), 2, '0') AS id, first, first + 21 AS last FROM (SELECT w, DATE '2024-01-01' + CAST(7 * (w - 1) AS INTEGER) AS first FROM (SELECT unnest(generate_series(1, 52, 4)) AS w)) WHERE first <= DATE '2024-06-30' AND first + 21 >= DATE '2024-03-01'")(lambda spark, d: web.overlapping_crawls(_crawls(spark), F.lit(date(2024, 3, 1)), F.lit(date(2024, 6, 30))))
over_tables("quarter_hours", "SELECT strftime(t, '%Y%m%d%H%M%S') AS slot FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-31 22:45:00', TIMESTAMP '2024-02-02 01:10:00', INTERVAL 15 MINUTE)) AS t)")(lambda spark, d: web.quarter_hours(spark, datetime(2024, 1, 31, 22, 50, 13), datetime(2024, 2, 2, 1, 10)))
over_captures("news_urls", "SELECT DISTINCT url FROM captures WHERE CAST(doc_id AS BIGINT) % 3 <> 0")(
    lambda df: web.news_urls(df.sparkSession, write_lines(df.select(F.concat_ws("\t", "doc_id", F.lit("x"), F.lit(""), F.lit("1"), F.when(F.col("doc_id").cast("long") % 3 == 0, "BBC Monitoring").otherwise(F.col("url")), F.lit("end")).alias("value")).union(df.select(F.concat_ws("\t", F.lit("again"), F.lit("x"), F.lit(""), F.lit("1"), F.when(F.col("doc_id").cast("long") % 3 == 0, "ftp://x").otherwise(F.col("url"))))), "news"))
)


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    """Two items a feed, in three formats in turn; every address is in ten feeds or so."""
    k = F.col("doc_id")
    a, b = F.concat(F.lit("https://e.example/a/"), (k % 97).cast("string")), F.concat(F.lit("https://e.example/b/"), (k % 89).cast("string"))
    rss = F.concat(F.lit('<rss version="2.0"><channel><item><link>'), a, F.lit('</link><guid isPermaLink="false">x</guid></item><item><title>t</title><guid>'), b, F.lit("</guid></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="https://e.example/self"/><link rel="alternate" href="'), a, F.lit('"/></entry><entry><id>'), b, F.lit("</id></entry></feed>"))
    feed = F.concat(F.lit('{"version": "https://jsonfeed.org/version/1.1", "items": [{"id": "1", "external_url": "'), a, F.lit('"}, {"id": "'), b, F.lit('"}, {"id": "no address"}]}'))
    return table(spark, d, "documents").select(F.format_string("%09d", k).alias("feed"), F.when(k % 3 == 0, rss).when(k % 3 == 1, atom).otherwise(feed).alias("body"))


_FOUND = "found AS (SELECT url, arg_min(feed, feed || p) AS feed, CAST(min(p) AS INTEGER) AS position FROM (SELECT printf('%09d', doc_id) AS feed, 0 AS p, 'https://e.example/a/' || doc_id % 97 AS url FROM documents UNION ALL SELECT printf('%09d', doc_id), 1, 'https://e.example/b/' || doc_id % 89 FROM documents) GROUP BY url)"
over_tables("feed_urls", f"WITH {_FOUND} SELECT feed, position, url FROM found")(lambda spark, d: web.discovered(_feeds(spark, d)).select("feed", "position", "url"))
over_tables("unseen_urls", f"WITH {_FOUND} SELECT url FROM found WHERE NOT regexp_matches(url, '/a/[0-4]')")(
    lambda spark, d: web.unseen(web.discovered(_feeds(spark, d)), web.discovered(_feeds(spark, d)).filter(F.col("url").rlike("/a/[0-4]"))).select("url")
)


def _sitemaps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    pages = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.example/'), k, F.lit("</loc></url><url><loc>ftp://no</loc></url></urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>https://e.example/s"), k, F.lit(".xml</loc></sitemap></sitemapindex>"))
    return web.sitemap_rows(table(spark, d, "documents").select(k.alias("sitemap"), F.when(F.col("doc_id") % 2 == 0, pages).otherwise(index).alias("body")))


over_tables("sitemap_rows", "SELECT CAST(doc_id AS VARCHAR) AS sitemap, CASE WHEN doc_id % 2 = 0 THEN 'page' ELSE 'sitemap' END AS kind, 0 AS position, 'https://e.example/' || CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 's' || doc_id || '.xml' END AS url FROM documents")(_sitemaps)


def _index_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.col("event_id"))
    line = F.to_json(F.struct(F.concat(F.lit("https://e.example/"), F.col("user_id").cast("string")).alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), F.concat(F.lit("f"), (F.col("k") % 7).cast("string")).alias("filename"), (F.col("k") * 10).cast("string").alias("offset"), F.lit("10").alias("length"), F.when(F.col("event_type") == "error", "404").otherwise("200").alias("status"), F.when(F.col("event_type") == "view", "image/png").otherwise("text/html").alias("mime")))
    rows = e.select(F.concat(F.lit("c"), (F.col("k") % 2).cast("string")).alias("crawl"), F.lit(date(2024, 1, 3)).alias("first"), F.lit(date(2024, 1, 24)).alias("last"), line.alias("value"))
    return web.index_records(rows.union(rows.limit(50)).union(rows.limit(1).withColumn("value", F.lit("{torn"))), F.lit(date(2024, 1, 5)), F.lit(date(2024, 2, 20)))


over_tables(
    "index_records",
    "WITH e AS (SELECT 'c' || event_id % 2 AS crawl, 'https://e.example/' || user_id AS url, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS fetched, 'f' || event_id % 7 AS filename, event_id * 10 AS first_byte FROM events WHERE event_type NOT IN ('error', 'view') AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-24') SELECT crawl, url, fetched, filename, first_byte, first_byte + 9 AS last_byte FROM e",
)(lambda spark, d: _index_lines(spark, d).withColumn("fetched", F.unix_seconds("fetched")))
over_tables("board_listings", "SELECT CAST(o_custkey AS VARCHAR) AS company, 'Job ' || o_orderkey AS title, 'https://j.example/' || o_orderkey AS url, o_orderpriority AS location, 'ats' AS source FROM orders")(
    lambda spark, d: web.board_listings(
        table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("company")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("Job "), F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("https://j.example/"), F.col("o_orderkey").cast("string")).alias("absolute_url"), F.struct(F.col("o_orderpriority").alias("name")).alias("location"))).alias("jobs"))).alias("body")), "greenhouse"
    ).drop("published_at")
)
over_tables("listing_details", "SELECT o_orderkey AS position, 'Job ' || o_orderkey AS title, o_orderpriority AS location FROM orders")(
    lambda spark, d: web.listing_details(table(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.concat(F.lit('<h1 class="a topcard__title b"> Job '), F.col("o_orderkey").cast("string"), F.lit('</h1>\n<span class="topcard__flavor--bullet">'), "o_orderpriority", F.lit("</span>")).alias("html"))).select(F.col("url").alias("position"), "title", "location")
)


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    """The same stream taken into one table twice, from new checkpoints: nothing is there twice."""
    folder = shared_subdir(spark, "loaded")
    for k in range(2):
        rows = registry._stream(spark, d).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("capture_id"), "event_type")
        streams.each_batch(rows, streams.loading_into(folder), shared_subdir(spark, f"loading-{k}")).awaitTermination()
    return spark.read.parquet(folder)


over_tables("stream_loading", "SELECT 'e' || event_id AS capture_id, event_type FROM events")(_loaded)


# ---- many rules, stems, stateful streams, chunked output -------------------------------------------------------------------------

MANY = [alerts.Rule(k, w, w, "term_spike" if k % 3 else "term_count", 1 + k % 4, 12 * (1 + k % 5)) for k, w in enumerate(sorted(ANALYTICS_STOPWORDS))]
over_captures(
    "alerts_many_rules",
    f""", r(rule_id, kind, term, threshold, hours) AS (VALUES {', '.join(f"({r.id}, '{r.kind}', '{r.term}', CAST({r.threshold} AS DOUBLE), {int(r.window_hours)})" for r in MANY)}),
w AS (SELECT DISTINCT capture_id, fetch_ts, unnest(regexp_extract_all(lower(title || chr(10) || text), '[a-z0-9_]+')) AS t FROM captures),
h AS (SELECT rule_id, count(*) FILTER (WHERE fetch_ts >= TIMESTAMP '{AS_OF}' - to_hours(hours)) AS n, count(*) FILTER (WHERE fetch_ts < TIMESTAMP '{AS_OF}' - to_hours(hours)) AS b
  FROM r JOIN w ON t = term AND fetch_ts < TIMESTAMP '{AS_OF}' AND fetch_ts >= TIMESTAMP '{AS_OF}' - to_hours(hours + 168) GROUP BY 1),
e AS (SELECT rule_id, kind, term, threshold, coalesce(n, 0) AS n, coalesce(b, 0) / 7 AS baseline FROM r LEFT JOIN h USING (rule_id)),
q AS (SELECT *, CASE WHEN kind = 'term_spike' THEN greatest(threshold, CASE WHEN baseline > 0 THEN 3.0 * baseline ELSE 3.0 END) ELSE threshold END AS required FROM e)
SELECT rule_id, kind, term, n AS count, round(baseline, 4) AS baseline, round(required, 4) AS required, n >= required AS fired FROM q""",
)(lambda df: alerts.evaluated(df, MANY, as_of()))


def _stemmed_scores(df: DataFrame) -> DataFrame:
    return search.postings(df, stem=stemmer.stems).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf_text").alias("occurrences")).orderBy(F.desc("df"), "term")


over_captures("stemmed_frequencies")(_stemmed_scores)
over_captures("stemmed_search")(lambda df: search.search(df, "thering theing", mode="fts", prune=False, stemmer=stemmer).rows.select("capture_id", "final_score", "snippet"))


def _window_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("feed"), F.col("event_type").alias("url"), F.col("event_id").cast("long").alias("position"))
    folder = shared_subdir(spark, "seen-window-in")
    rows.write.parquet(folder)
    return streams.drained(stateful.seen_window(streams.file_stream(spark, folder, rows.schema), cap=2), "seen-window")


over_tables(
    "stream_seen_window",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS feed, event_type AS url, event_id AS position FROM events),
p AS (SELECT *, lag(position) OVER (PARTITION BY feed, url ORDER BY position) AS before FROM e)
SELECT feed, url, position FROM p WHERE before IS NULL OR (SELECT count(DISTINCT o.url) FROM e o WHERE o.feed = p.feed AND o.position > p.before AND o.position < p.position) >= 2""",
)(_window_events)


def _stream_links(spark: SparkSession, d: str) -> DataFrame:
    """The nearest earlier signature of each document, as documents arrive. No SQL: a test holds it against the form for tables."""
    rows = dedup.signatures(captures(spark, d, False).dropDuplicates(["content_hash"]).withColumn("nid", F.col("doc_id").cast("long")), key="nid").filter("hi IS NOT NULL")
    folder = shared_subdir(spark, "near-links-in")
    rows.write.parquet(folder)
    masks = dedup.sample_masks(*dedup.sampling_plan(1_000_000))
    links = stateful.near_links(streams.file_stream(spark, folder, rows.schema), masks, dedup.THRESHOLD)
    return stateful.nearest(streams.drained(links, "near-links"))


over_tables("stream_near_links")(_stream_links)


def _chunked_lines(spark: SparkSession, d: str) -> DataFrame:
    datasource.register(spark)
    folder = shared_subdir(spark, "chunked-lines")
    captures(spark, d, False).select("capture_id", "title", "text").write.format("tidewrack_jsonl").option("path", folder).option("records", 1000).mode("append").save()
    return spark.read.schema("capture_id string, title string, text string").json(folder).select("capture_id", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"))


over_tables("chunked_lines", f"WITH {CAPTURES_SQL} SELECT capture_id, title, md5(text) AS text_md5 FROM captures")(_chunked_lines)


# ---- archives as streams, learnt languages, substrings by an index -----------------------------------------------------------


def _archive_stream(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as archives, and read back as a stream in pieces."""
    datasource.register(spark)
    folder = shared_subdir(spark, "archive-stream")
    captures(spark, d, False).select(F.lit("response").alias("record_type"), "url", F.col("text").cast("binary").alias("payload")).write.format("tidewrack_warc").option("path", folder).mode("append").save()
    stream = spark.readStream.format("tidewrack_warc").option("split_bytes", 8 << 20).load(folder)
    return streams.drained(stream, "archive-stream-out").select("record_type", "url", F.md5("payload").alias("payload_md5"))


over_tables("archive_stream", f"WITH {CAPTURES_SQL} SELECT 'response' AS record_type, url, md5(coalesce(text, '')) AS payload_md5 FROM captures")(_archive_stream)


def _learned_language(df: DataFrame) -> DataFrame:
    """Profiles are learnt from four fifths of the rows, by a hash of the id; all rows are told."""
    df = df.withColumn("held_out", F.crc32(F.col("doc_id").cast("binary")) % 5 == 0)
    detect = langprofile.detector(langprofile.learn(df.filter("NOT held_out")))
    return df.select("capture_id", "language", "held_out", detect(F.col("text")).alias("x")).select("capture_id", "language", "held_out", F.col("x.language").alias("detected"), F.round("x.confidence", 6).alias("confidence"))


over_captures("learned_language")(_learned_language)

INDEXED_ROOTS = ["theand", "ung des", "zzzz"]


def _indexed_substrings(df: DataFrame) -> DataFrame:
    index = substrings.SubstringIndex(df.sparkSession, shared_subdir(df.sparkSession, "substring-index")).build(df.select("capture_id", "title", "text"))
    return index.matches(INDEXED_ROOTS).select("capture_id")


over_captures("indexed_substrings", "SELECT capture_id FROM captures WHERE " + " OR ".join(f"{c} ILIKE '%{r}%'" for r in INDEXED_ROOTS for c in ("title", "text")))(_indexed_substrings)
over_captures("corpus_weighted_signatures")(lambda df: dedup.corpus_weighted_signatures(df, key="capture_id"))
