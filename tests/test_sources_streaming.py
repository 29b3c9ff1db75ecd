import gzip
import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tidewrack.schema import CAPTURES
from tidewrack.sources import datasource, jsonl, web
from tidewrack.streaming import streams


def record(kind, body, url="https://example.com/a"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_jsonl_repairs(spark, tmp_path):
    day = tmp_path / "2024" / "01" / "02"
    day.mkdir(parents=True)
    good = {"capture_id": "c1", "doc_id": "d", "text": "t", "fetch_ts": "2024-01-02T03:04:05.123456789Z", "near_dup_hash": "x"}
    (day / "a.jsonl").write_text(json.dumps(good) + "\nnot json\n" + json.dumps({"capture_id": "c2", "fetch_ts": "bad"}) + "\n")
    with gzip.open(day / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"capture_id": "c3"}) + "\n")
    (day / "c.jsonl.tmp").write_text(json.dumps({"capture_id": "c4"}) + "\n")
    df = jsonl.read_jsonl(spark, str(tmp_path))
    rows = {r.capture_id: r for r in df.collect()}
    assert set(rows) == {"c1", "c2", "c3"} and df.columns == CAPTURES.names and len(df.columns) == 29
    assert rows["c1"].fetch_ts == datetime(2024, 1, 2, 3, 4, 5, 123456) and rows["c1"].near_dup_hash is None and rows["c2"].fetch_ts is None
    assert jsonl.bad_records(spark, str(tmp_path)).count() == 1
    assert jsonl.fixture(spark, [{"capture_id": "a", "text": "x" * 60}, {"capture_id": "b", "text": "x"}]).count() == 1
    assert jsonl.union_captures(df, df.select("capture_id")).count() == 6


def test_warc(spark, tmp_path):
    text = ("The people of the town have to be kind and that is good with all. " * 10).encode()
    wet = record("warcinfo", b"x") + record("conversion", text) + record("conversion", b"short") + record("response", b"HTTP/1.1 200 OK\r\n\r\n<html><title>T</title><p>" + text + b"</p></html>")
    (tmp_path / "a.wet.gz").write_bytes(gzip.compress(wet + b"WARC/1.0\r\nContent-Length: 50\r\n\r\ntorn"))
    rows = web.read_warc(spark, str(tmp_path))
    assert rows.count() == 4
    caps = web.wet_captures(rows).collect()
    assert [(c.domain, c.language, c.ordinal) for c in caps] == [("example.com", "en", 1)]
    assert web.wet_captures(rows, domains=["other.com"]).count() == 0 and web.wet_captures(rows, after=1).count() == 0
    assert [r.title for r in web.response_captures(rows).collect()] == ["T"]
    datasource.register(spark)
    assert spark.read.format("tidewrack_warc").load(str(tmp_path)).count() == 4


def test_planning(spark):
    assert web.crawl_window("CC-MAIN-2024-10") == (date(2024, 3, 4), date(2024, 3, 25)) and web.crawl_window("x") is None
    crawls = spark.createDataFrame([("a", *web.crawl_window("CC-MAIN-2024-10")), ("b", *web.crawl_window("CC-MAIN-2023-50"))], "id string, first date, last date")
    assert [r.id for r in web.overlapping_crawls(crawls, F.lit("2024-03-20").cast("date"), F.lit("2024-04-01").cast("date")).collect()] == ["a"]
    assert [r.slot for r in web.quarter_hours(spark, datetime(2024, 1, 1, 0, 7), datetime(2024, 1, 1, 0, 31)).collect()] == ["20240101000000", "20240101001500", "20240101003000"]
    assert web.latest_slot(datetime(2024, 1, 1, 1, 0)) == "20240101003000" and web.dataset_for(["en"]) == "english" and web.dataset_for(["fr"]) == "multilingual"


def test_feeds(spark, tmp_path):
    rss = "<rss><channel><item><link>https://a.com/1?utm_source=x</link></item><item><guid>https://a.com/1</guid></item><item><guid isPermaLink='false'>https://a.com/no</guid><enclosure url='https://a.com/3'/></item></channel></rss>"
    assert web.feed_urls(rss) == ["https://a.com/1?utm_source=x", "https://a.com/1", "https://a.com/3"] and web.feed_urls("<broken") == []
    assert web.json_feed_urls(json.dumps({"version": "https://jsonfeed.org/version/1", "items": [{"id": "1", "external_url": "https://b.com"}, {"id": "x"}]})) == ["https://b.com"]
    assert web.sitemap_locs("<urlset xmlns='x'><url><loc>https://a.com/p</loc></url></urlset>") == (["https://a.com/p"], [])
    found = web.discovered(spark.createDataFrame([("f", rss)], "feed string, body string"))
    assert found.count() == 2 and web.unseen(found, found.limit(1)).count() == 1
    (tmp_path / "g.tsv").write_text("1\t2\t3\t4\thttps://a.com\n1\t2\t3\t4\tftp://x\nshort\n")
    assert [r.url for r in web.news_urls(spark, str(tmp_path / "g.tsv")).collect()] == ["https://a.com"]
    board = spark.createDataFrame([("c", json.dumps({"jobs": [{"title": "T", "absolute_url": "u", "location": {"name": "L"}}]}))], "company string, body string")
    assert [(r.title, r.location) for r in web.board_listings(board, "greenhouse").collect()] == [("T", "L")]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k % 3, datetime(2024, 1, 1, k % 24, k % 60)) for k in range(200)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: streams.file_stream(spark, str(tmp_path / "in"), df.schema, 1)
    got = streams.drained(streams.tumbling(stream(), "1 hour"), "t_tumbling", "complete")
    assert got.agg(F.sum("count")).first()[0] == 200 and got.count() == df.select(F.date_trunc("hour", "ts")).distinct().count()
    assert streams.drained(streams.distinct_keys(stream(), "user_id"), "t_distinct").count() == 3
    assert streams.drained(streams.first_seen(stream(), "user_id"), "t_seen").count() == 3
    caps = spark.createDataFrame([("c1", "x"), ("c2", "y"), ("c1", "x")], "capture_id string, text string")
    caps.write.parquet(str(tmp_path / "caps"))
    for run in range(2):
        streams.each_batch(streams.file_stream(spark, str(tmp_path / "caps"), caps.schema), streams.loading_into(str(tmp_path / "out")), str(tmp_path / f"ck{run}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
