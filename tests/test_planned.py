import random
from datetime import date, timedelta
from time import monotonic

from tidewrack.operators import operations

REQUESTS = "job_id long, source string, first date, last date, max_tasks int"
PARTITIONS = "source string, partition_key string, first date, last date"
ZERO = date(1969, 12, 1)  # days before and after the zero of their numbers


def day(n):
    return ZERO + timedelta(days=n)


def one_by_one(requests, partitions):
    out = []
    for job, source, first, last, most in requests:
        met = sorted((p[2], p[1]) for p in partitions if p[0] == source and p[2] <= last and p[3] >= first)
        out += [(job, key, None) for _, key in met[: len(met) if most is None else most]]
        if not met:
            out.append((job, None, "outside_window" if any(p[0] == source for p in partitions) else "no_partitions"))
    return sorted(out, key=str)


def test_planned_matches_one_by_one(spark):
    r = random.Random(5)
    for longest in (0, 3, 40):
        # some periods end before they start
        spans = [(day(a), day(a + r.randint(-2, longest))) for a in (r.randint(0, 70) for _ in range(400))]
        partitions = [(r.choice("abc"), f"p{k}", *spans[k]) for k in range(250)]
        requests = [(k, r.choice("abcd"), *spans[250 + k], r.choice([None, 0, 1, 2, 5, 1000])) for k in range(150)]
        got = operations.planned(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(partitions, PARTITIONS))
        assert sorted(map(tuple, got.collect()), key=str) == one_by_one(requests, partitions)


def test_planned_joins_only_what_meets(spark):
    n, began = 20_000, monotonic()  # a source in common, so 400 million pairs in all
    days = spark.range(n).selectExpr("id", "'s' AS source", "date_add(date'1970-01-01', cast(id as int)) AS first", "date_add(date'1970-01-01', cast(id as int)) AS last")
    requests = days.selectExpr("id AS job_id", "source", "first", "last", "cast(if(id % 2 = 0, 1, null) as int) AS max_tasks")
    got = operations.planned(requests, days.selectExpr("source", "cast(id as string) AS partition_key", "first", "last"))
    assert got.filter("partition_key = cast(job_id as string) AND reason IS NULL").count() == n
    assert monotonic() - began < 60
