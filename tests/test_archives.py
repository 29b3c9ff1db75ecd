"""Archives by pieces: every split reads the same records, damaged members are passed over, a stopped stream loses and repeats nothing."""

import gzip
import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewrack.sources import archives, datasource


def record(body: bytes, url: str = "https://a.example/", kind: str = "response") -> bytes:
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def bodies(n: int, seed: int) -> list[bytes]:
    rng = random.Random(seed)
    found = [b"", b"WARC/1.0\r\n\r\n", archives._MAGIC * 50, rng.randbytes(700_000), b"a" * 900_000, gzip.compress(b"not an archive")]
    return found + [rng.randbytes(rng.randrange(3000)) for _ in range(n)]


def read_all(data: bytes, split: int) -> list[bytes]:
    from tidewrack.sources.web import records_of

    return [body for a in range(0, len(data), split) for _, s in archives.units(io.BytesIO(data), a, min(a + split, len(data))) for _, body in records_of(s)]


@pytest.mark.parametrize("split", [37, 1000, 4096, 100_000, 1 << 30])
def test_every_split_reads_each_record_once(split):
    want = bodies(40 if split > 100 else 3, 1)
    if split < 100:
        want = [b for b in want if len(b) < 5000]
    assert read_all(b"".join(gzip.compress(record(b)) for b in want), split) == want


@pytest.mark.parametrize("split", [500, 1 << 30])
def test_records_of_several_members_and_of_one(split):
    raw = record(b"x" * 5000) + record(b"y")
    assert read_all(gzip.compress(raw), split) == [b"x" * 5000, b"y"]
    cut = b"".join(gzip.compress(raw[k : k + 700]) for k in range(0, len(raw), 700))
    assert read_all(cut + gzip.compress(record(b"z")), split) == [b"x" * 5000, b"y", b"z"]


@pytest.mark.parametrize("split", [300, 1 << 30])
def test_damaged_and_torn_members_are_passed_over(split):
    rng = random.Random(4)
    want = [rng.randbytes(2000) for _ in range(5)]
    parts = [gzip.compress(record(b)) for b in want]
    parts[2] = parts[2][:900] + b"\xff" * 200 + parts[2][1100:]
    got = read_all(b"".join(parts[:4]) + parts[4][:800], split)
    assert got == [want[0], want[1], want[3]]


def test_written_read_and_empty(spark, tmp_path):
    datasource.register(spark)
    rows = spark.createDataFrame([("response", f"https://a.example/{k}", bytes([k % 256]) * k) for k in range(300)] + [(None, None, None)], "record_type string, url string, payload binary")
    folder = str(tmp_path / "w")
    rows.repartition(3).select("payload", "url", "record_type", F.lit(1).alias("path")).write.format("tidewrack_warc").option("bytes", 2000).mode("append").save(folder)
    assert not [n for n in os.listdir(folder) if not n.endswith(".warc.gz") or n.startswith(".")] and len(os.listdir(folder)) > 3
    got = spark.read.format("tidewrack_warc").option("split_bytes", 500).load(folder)
    assert {(r.record_type, r.url, bytes(r.payload)) for r in got.collect()} == {(a or "resource", b, bytes(c or b"")) for a, b, c in rows.collect()} and got.count() == 301
    (tmp_path / "none").mkdir()
    assert spark.read.format("tidewrack_warc").load(str(tmp_path / "none")).count() == 0


def test_stopped_stream_loses_and_repeats_nothing(spark, tmp_path):
    datasource.register(spark)
    folder, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    rng = random.Random(5)
    rows = lambda a, b: spark.createDataFrame([("response", f"u{k}", rng.randbytes(600)) for k in range(a, b)], "record_type string, url string, payload binary")
    rows(0, 200).coalesce(2).write.format("tidewrack_warc").mode("append").save(folder)

    def run(enough: int) -> None:
        """Until that many records are there, in batches of some files' parts; then the stream is stopped wherever it is."""
        stream = spark.readStream.format("tidewrack_warc").option("split_bytes", 5000).option("batch_bytes", 20_000).load(folder)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(processingTime="0 seconds").start()
        end = time.time() + 90
        while time.time() < end and q.exception() is None:
            if sum(p["numInputRows"] for p in q.recentProgress) >= enough:
                break
            time.sleep(0.05)
        assert q.exception() is None
        q.stop()

    run(40)
    first = spark.read.parquet(out).count()
    assert 0 < first < 200
    rows(200, 300).coalesce(1).write.format("tidewrack_warc").mode("append").save(folder)
    run(300 - first)
    got = spark.read.parquet(out)
    assert got.count() == 300 and got.select("url").distinct().count() == 300
    assert sorted(got.select("url", "path", "first_byte", "ordinal").collect()) == sorted(spark.read.format("tidewrack_warc").load(folder).select("url", "path", "first_byte", "ordinal").collect())
