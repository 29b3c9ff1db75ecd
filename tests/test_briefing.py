from datetime import timedelta

from pyspark.sql import functions as F

from tests.test_operators import DAY, make
from tidewrack.operators import briefing


def test_briefing(spark):
    rows = [{"text": "good news", "at": DAY - timedelta(days=d), "title": "Alpha beta"} for d in range(1, 14)] + [{"text": "bad news", "title": "Alpha beta", "group": "g"}] * 8
    df = make(spark, rows)
    assert [r.term for r in briefing.movers(df, ["news", "zzz"], 13).collect()] == ["news"]
    shift = briefing.sentiment_shift(df, "news").first()
    assert (shift["last"], shift.before, shift["shift"]) == (-1.0, 1.0, "down")
    assert briefing.quality_trend(df).first().last7 == 0.0
    assert "## terms" in briefing.report(df, F.expr("timestamp_ntz'2024-06-11 00:00:00'"))
    assert briefing.detail(df, "cap-0013").first().related_count == 7 and briefing.health(df).first().captures == 21
    assert briefing.dedup_check(df, "bad news").filter("distance = 0").count() == 8
    saved = spark.createDataFrame([("s", "news", None)], "name string, query string, mode string")
    assert briefing.run_saved(df, saved, "s").total == 2
    got = []
    briefing.delivering(got.append, True)(spark.createDataFrame([(1, 5, "t", 2.0)], "rule_id int, count int, term string, required double"), 0)
    assert got == [{"text": "Alert 1: 5 documents match 't' (at least 2)"}]
    messages = briefing.simulated_messages(spark, "x", 300, 3)
    assert messages.count() == 200 and messages.collect() == briefing.simulated_messages(spark, "x", 300, 3).collect()
