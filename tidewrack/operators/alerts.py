"""Alert rules: all in one scan, with cooldown, and summaries of firings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.manyterms import terms_found
from tidewrack.functions.tokens import matches
from tidewrack.functions.windows import checked_limit, pruned

SPIKE_FACTOR, SPIKE_FLOOR, BASELINE_DAYS = 3.0, 3.0, 7


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    term: str
    kind: str = "term_count"
    threshold: float = 1.0
    window_hours: float = 24.0
    cooldown_minutes: float = 60.0


#: Rules beyond which texts are read once for all of them, by an automaton.
MANY_RULES = 16


def _interval(hours: float) -> Column:
    return F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(hours % 1 * 60)))


def _counted(part: DataFrame, rules: list[Rule], as_of: Column) -> DataFrame:
    """rule_id, kind, term, threshold, count, baseline of each rule: a conditional count for each."""
    hits, counts = {}, []
    for k, r in enumerate(rules):
        start = as_of - _interval(r.window_hours)
        now = (F.col("fetch_ts") >= start) & (F.col("fetch_ts") < as_of)
        before = (F.col("fetch_ts") >= start - _interval(24 * BASELINE_DAYS)) & (F.col("fetch_ts") < start)
        hits[f"__{k}"] = F.when((now | before) & matches(r.term), now)  # whether a hit is in the window; the time is looked at first
        counts.append(F.count(F.when(F.col(f"__{k}"), True)).alias(f"c{k}"))
        counts.append(F.count(F.when(~F.col(f"__{k}"), True)).alias(f"b{k}"))
    one = part.select(*[c.alias(n) for n, c in hits.items()]).agg(*counts)
    each = F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.term).alias("term"), F.lit(float(r.threshold)).alias("threshold"), F.col(f"c{k}").alias("count"), (F.col(f"b{k}") / BASELINE_DAYS).alias("baseline")) for k, r in enumerate(rules)]))
    return one.select(each.alias("r")).select("r.*")


def _counted_at_once(part: DataFrame, rules: list[Rule], as_of: Column) -> DataFrame:
    """The same for any number of rules: each text is read once, its terms are rows, and they meet the rules, which are broadcast."""
    terms = sorted({r.term.strip().lower() for r in rules})
    number = {t: k for k, t in enumerate(terms)}
    table = part.sparkSession.createDataFrame([(r.id, r.kind, r.term, float(r.threshold), int(r.window_hours * 3600), number[r.term.strip().lower()]) for r in rules], "rule_id int, kind string, term string, threshold double, seconds long, number int")
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("fetch_ts").cast("timestamp"))
    rows = part.filter(age > 0).select(age.alias("age"), F.explode(terms_found(terms, "title", "text")).alias("number"))
    # as many rows as there are terms and different ages at most, before any rule is looked at
    met = rows.groupBy("number", "age").agg(F.count("*").alias("n")).join(F.broadcast(table.select("number", "rule_id", "seconds")), "number")
    inside, upto = F.col("age") <= F.col("seconds") * 1_000_000, F.col("age") <= (F.col("seconds") + 86_400 * BASELINE_DAYS) * 1_000_000
    counts = met.groupBy("rule_id").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(~inside & upto, F.col("n")).otherwise(0)).alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return table.join(counts, "rule_id", "left").select("rule_id", "kind", "term", "threshold", zero("c").alias("count"), (zero("b") / BASELINE_DAYS).alias("baseline"))


def evaluated(df: DataFrame, rules: list[Rule], as_of: Column) -> DataFrame:
    """rule_id, kind, term, count, baseline, required, fired of every rule: counts in [as_of - window, as_of), the baseline over the seven days before.

    Rules have ids of their own. Beyond MANY_RULES rules, those with ASCII terms are looked for all at once; the counts are the same.
    """
    longest = max(r.window_hours for r in rules)
    part = pruned(df, as_of - _interval(longest) - _interval(24 * BASELINE_DAYS), as_of)
    plain = [r for r in rules if r.term.isascii()] if len(rules) > MANY_RULES else []
    others = [r for r in rules if r not in plain]
    parts = [_counted_at_once(part, plain, as_of)] * bool(plain) + ([_counted(part, others, as_of)] if others else [])
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    spike = F.greatest("threshold", F.when(F.col("baseline") > 0, SPIKE_FACTOR * F.col("baseline")).otherwise(SPIKE_FLOOR))
    required = F.when(F.col("kind") == "term_spike", spike).otherwise(F.col("threshold"))
    return rows.select("rule_id", "kind", "term", "count", F.round("baseline", 4).alias("baseline"), F.round(required, 4).alias("required"), (F.col("count") >= required).alias("fired"))


def fired(df: DataFrame, rules: list[Rule], as_of: Column, firings: DataFrame | None = None) -> DataFrame:
    """Rules that fire now and are not in cooldown by their last firing (rule_id, fired_at)."""
    rows = evaluated(df, rules, as_of).filter("fired")
    if firings is None:
        return rows
    last = firings.groupBy("rule_id").agg(F.max("fired_at").alias("last"))
    minutes = F.coalesce(*[F.when(F.col("rule_id") == r.id, F.lit(float(r.cooldown_minutes))) for r in rules])
    waiting = (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / 60 < minutes
    return rows.join(last, "rule_id", "left").filter(~F.coalesce(waiting, F.lit(False))).drop("last")


def by_weekday(firings: DataFrame, time: str = "fired_at") -> DataFrame:
    """weekday (Monday 0), count, zeros included."""
    spark = firings.sparkSession
    counts = firings.groupBy(F.weekday(time).alias("weekday")).agg(F.count("*").alias("n"))
    return spark.range(7).select(F.col("id").cast("int").alias("weekday")).join(counts, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("count"))


def weekly(firings: DataFrame, since: Column) -> DataFrame:
    return firings.filter(F.col("fired_at") >= since).groupBy("rule_id").agg(F.count("*").alias("count"), F.max("fired_at").alias("last_fired"))


def newest_firings(firings: DataFrame, limit: int = 50, since: Column | None = None) -> DataFrame:
    part = firings if since is None else firings.filter(F.col("fired_at") >= since)
    return part.orderBy(F.desc("fired_at"), "rule_id").limit(checked_limit(limit))
