"""Planning and parsing for web sources: crawl windows, WARC and WET files, news slots, feeds, sitemaps, job boards.

Fetching stays outside Spark; these take what was fetched (files, or tables of bodies) and give tables.
"""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.html import extract
from tidewrack.functions.maintext import main_text
from tidewrack.functions.text import basic_clean, detect_language, gate_for_language, language_filter
from tidewrack.functions.urls import canonical_column, domain_column

# ---- crawl planning ----------------------------------------------------------------------------------------------------


def crawl_window(crawl: str, days: int = 21) -> tuple[date, date] | None:
    """From the Monday of the ISO week that a crawl id (CC-MAIN-2024-10) names, 21 days on; None for other ids."""
    m = re.fullmatch(r"CC-MAIN-(\d{4})-(\d{2})", crawl)
    try:
        first = date.fromisocalendar(int(m[1]), int(m[2]), 1) if m else None
    except ValueError:
        first = None
    return (first, first + timedelta(days=days)) if first else None


def overlapping_crawls(crawls: DataFrame, start: Column, end: Column) -> DataFrame:
    """crawls: id, first, last. Those whose window meets [start, end], newest first."""
    return crawls.filter((F.col("first") <= end) & (F.col("last") >= start)).orderBy(F.desc("first"), "id")


def shard_paths(spark: SparkSession, listing: str, most: int | None = None) -> DataFrame:
    """shard, path of a (gzipped) list of paths, in its order."""
    rows = spark.read.text(listing, wholetext=False).select(F.trim("value").alias("path")).filter("path <> ''").withColumn("shard", F.monotonically_increasing_id())
    return rows.select("shard", "path") if most is None else rows.orderBy("shard").limit(most).select("shard", "path")


_INDEX_LINE = "url string, timestamp string, filename string, `offset` string, length string, status string, mime string, digest string"


def index_records(lines: DataFrame, start: Column, end: Column, most: int | None = None) -> DataFrame:
    """lines: crawl, first, last, value (a line of an index reply, as JSON). Byte ranges of the archives to read: crawl, url, fetched, filename, first_byte, last_byte.

    Only successful HTML replies inside both the crawl's window and [start, end] count, each range once: all of them, or
    of each crawl the first `most` by address and time, as one query of an index may give no more.
    """
    rows = lines.select("crawl", "first", "last", F.from_json("value", _INDEX_LINE).alias("r")).select("crawl", "first", "last", "r.*")
    rows = rows.withColumn("fetched", F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss"))).withColumns({"first_byte": F.expr("try_cast(`offset` AS bigint)"), "size": F.expr("try_cast(length AS bigint)")})
    day = F.to_date("fetched")
    rows = rows.filter((F.col("status") == "200") & F.coalesce(F.col("mime").contains("html"), F.lit(True)) & day.between(F.col("first"), F.col("last")) & day.between(start, end) & F.col("first_byte").isNotNull() & (F.col("size") > 0))
    rows = rows.dropDuplicates(["crawl", "filename", "first_byte"])
    if most is not None:
        place = F.row_number().over(Window.partitionBy("crawl").orderBy("url", "fetched", "filename", "first_byte"))
        rows = rows.withColumn("place", place).filter(F.col("place") <= most)
    return rows.select("crawl", "url", "fetched", "filename", "first_byte", (F.col("first_byte") + F.col("size") - 1).alias("last_byte"))


def index_pages(matches: int, page: int = 100, most: int = 5_000) -> list[tuple[int, int]]:
    """(page, limit) of the queries that fetch so many matches of an index."""
    left = max(0, min(matches, most))
    return [(k, min(page, left - k * page)) for k in range(-(-left // page))]


# ---- WARC and WET --------------------------------------------------------------------------------------------------------

_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "record_type", "record_id", "url", "record_date", "content_type")] + [T.StructField("ordinal", T.LongType()), T.StructField("payload", T.BinaryType())])


def records_of(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower case) and bodies of the WARC records of an open file, one record in memory at a time; a torn last record ends it."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers.get("content-length", 0) or 0)
        body = f.read(size)
        if not line or len(body) < size:
            return
        yield headers, body


def opened(f: BinaryIO, name: str) -> BinaryIO:
    """A stream that is read by lines and pieces; .gz files are unpacked on the way, however many members they have."""
    return io.BufferedReader(gzip.GzipFile(fileobj=f) if name.endswith(".gz") else f, 1 << 20)


_BATCH_BYTES = 8 << 20


def _record_batches(path: str, f: BinaryIO) -> Iterator[pa.RecordBatch]:
    names = [x.name for x in _RECORD]
    types = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    rows, held = [], 0
    for k, (h, body) in enumerate(records_of(f)):
        rows.append((path, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri", "").strip("<>") or None, h.get("warc-date"), h.get("content-type"), k, body))
        held += len(body)
        if held > _BATCH_BYTES or len(rows) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            yield from _record_batches(path, opened(io.BytesIO(content), path))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
            with system.open_input_stream(name, compression=None) as f:
                yield from _record_batches(path, opened(f, name))


def read_warc(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Records of WARC or WET files: path, record_type, record_id, url, record_date, content_type, ordinal, payload.

    Files are dealt to tasks and read as streams, so they may be of any size. whole lets Spark read them (up to 2 GB each),
    for stores that only Spark reaches.
    """
    files = spark.read.format("binaryFile").load(path)
    if whole:
        return files.select("path", "content").mapInArrow(_parsed, _RECORD)
    names = files.select("path")
    return names.repartition(max(1, min(names.count(), 10_000))).mapInArrow(_streamed, _RECORD)


def wet_captures(records: DataFrame, domains: list[str] | None = None, languages: list[str] | None = None, min_chars: int = 200, quality: bool = True, after: int | None = None, detect: Callable[[Column], Column] = detect_language) -> DataFrame:
    """Conversion records as captures, in the order of the tests: domain, length, language, quality gate. after resumes behind an ordinal; detect tells the language of a text."""
    rows = records.filter("record_type = 'conversion'")
    rows = rows if after is None else rows.filter(F.col("ordinal") > after)
    rows = rows.withColumn("domain", domain_column("url"))
    if domains:
        rows = rows.filter(F.col("domain").isin([d.lower() for d in domains]))
    rows = rows.withColumn("text", basic_clean(F.decode("payload", "UTF-8"))).filter(F.length("text") >= min_chars)
    rows = rows.withColumn("language", detect(F.col("text")))
    if languages:
        wanted = language_filter(languages[0])
        for x in languages[1:]:
            wanted = wanted | language_filter(x)
        rows = rows.filter(wanted)
    if quality:
        rows = rows.filter(gate_for_language(F.col("text"), F.col("language")).isNull())
    return rows.select("path", "ordinal", "record_id", "url", canonical_column("url").alias("canonical_url"), "domain", "language", "text", F.to_timestamp("record_date").alias("fetch_ts"))


_PAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "text")])


@F.arrow_udf(_PAGE)
def _response_text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        rows = []
        for body in part.to_pylist():
            html = (body or b"").partition(b"\r\n\r\n")[2].decode("utf-8", "replace")
            rows.append(extract(html)[:2])
        yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["title", "text"])


@F.arrow_udf(_PAGE)
def main_response_text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Title and main text of response payloads, for response_captures."""
    for part in parts:
        pages = [main_text((body or b"").partition(b"\r\n\r\n")[2].decode("utf-8", "replace")) for body in part.to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([p.title for p in pages], pa.string()), pa.array([p.text for p in pages], pa.string())], ["title", "text"])


def response_captures(records: DataFrame, min_chars: int = 200, reader: Callable[[str], Column] = _response_text) -> DataFrame:
    """Response records as title and text of their HTML: all text outside menus, or by reader (main_response_text: the main text)."""
    rows = records.filter("record_type = 'response'").withColumn("x", reader("payload"))
    return rows.select("path", "ordinal", "record_id", "url", "x.title", "x.text").filter(F.length("text") >= min_chars)


def dataset_rows(df: DataFrame, languages: list[str] | None = None, domains: list[str] | None = None, min_chars: int = 200, offset: int = 0) -> DataFrame:
    """Rows of a text dataset (text, url, language), filtered; offset is a row position column if there is one."""
    rows = df.withColumn("domain", domain_column("url")).filter(F.length("text") >= min_chars)
    rows = rows.filter(F.col("position") >= offset) if "position" in df.columns else rows
    rows = rows.filter(F.col("language").isin(languages)) if languages else rows
    return rows.filter(F.col("domain").isin(domains)) if domains else rows


def dataset_for(languages: list[str] | None) -> str:
    """Which of two corpora serves the languages: the English one for English or none asked, else the multilingual one."""
    asked = {x.split("-")[0].lower() for x in languages or ()}
    return "english" if not asked or asked == {"en"} else "multilingual"


# ---- news slots --------------------------------------------------------------------------------------------------------------


def quarter_hours(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """slot: each quarter of an hour from the one that start lies in up to end, as yyyyMMddHHmmss."""
    first = start.replace(minute=start.minute // 15 * 15, second=0, microsecond=0)
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("interval 15 minutes"))).alias("t")) if first <= end else spark.range(0).select(F.lit(first).cast("timestamp_ntz").alias("t"))
    return rows.select(F.date_format("t", "yyyyMMddHHmmss").alias("slot"))


def latest_slot(now: datetime, lag_minutes: int = 30) -> str:
    t = now - timedelta(minutes=lag_minutes)
    return t.replace(minute=t.minute // 15 * 15, second=0).strftime("%Y%m%d%H%M%S")


def news_urls(spark: SparkSession, path: str) -> DataFrame:
    """The distinct http addresses of the fifth column of tab-separated records."""
    lines = spark.read.text(path).select(F.get(F.split("value", "\t"), F.lit(4)).alias("url"))
    return lines.filter(F.col("url").rlike("(?i)^https?://")).distinct()


# ---- feeds -----------------------------------------------------------------------------------------------------------------


def _http(value) -> str | None:
    return value.strip() if isinstance(value, str) and re.match(r"https?://", value.strip(), re.IGNORECASE) else None


def json_feed_urls(body: str) -> list[str] | None:
    """Addresses of a JSON feed's items (url, else external_url, else an id that is an address); None if it is no such feed."""
    try:
        feed = json.loads(body)
    except ValueError:
        return None
    if not isinstance(feed, dict) or "jsonfeed.org" not in str(feed.get("version", "")) or not isinstance(feed.get("items"), list):
        return None
    return [u for i in feed["items"] if isinstance(i, dict) and (u := next((x for k in ("url", "external_url", "id") if (x := _http(i.get(k)))), None))]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def feed_urls(body: str) -> list[str]:
    """Permalinks of RSS, Atom or JSON feeds: original link, link, alternate link, guid, then media."""
    found = json_feed_urls(body)
    if found is not None:
        return found
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return []
    out = []
    for item in (e for e in root.iter() if _local(e.tag) in ("item", "entry")):
        by: dict[str, list] = {}
        for child in item.iter():
            by.setdefault(_local(child.tag), []).append(child)
        links = by.get("link", [])
        tries = [e.text for e in by.get("origlink", [])] + [e.text for e in links] + [e.get("href") for e in links if e.get("rel", "alternate") == "alternate"]
        tries += [e.text for e in by.get("guid", []) if e.get("isPermaLink", "true") != "false"] + [e.text for e in by.get("id", [])] + [e.get("url") for k in ("content", "enclosure") for e in by.get(k, [])]
        url = next((u for t in tries if (u := _http(t))), None)
        if url:
            out.append(url)
    return out


def sitemap_locs(body: str) -> tuple[list[str], list[str]]:
    """(addresses of pages, addresses of further sitemaps) of a sitemap or sitemap index."""
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return [], []
    locs = [u for e in root.iter() if _local(e.tag) == "loc" and (u := _http(e.text))]
    return ([], locs) if _local(root.tag) == "sitemapindex" else (locs, [])


@F.arrow_udf(T.StructType([T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("sitemaps", T.ArrayType(T.StringType()))]))
def _sitemap_column(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        rows = [sitemap_locs(x or "") for x in part.to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1)], ["pages", "sitemaps"])


def sitemap_rows(sitemaps: DataFrame) -> DataFrame:
    """sitemaps: sitemap, body. sitemap, kind (page or sitemap), position, url; what is of kind sitemap is to be fetched and read once more."""
    found = sitemaps.select("sitemap", _sitemap_column("body").alias("x"))
    kinds = [found.select("sitemap", F.lit(k).alias("kind"), F.posexplode(f"x.{k}s").alias("position", "url")) for k in ("page", "sitemap")]
    return kinds[0].union(kinds[1])


@F.arrow_udf(T.ArrayType(T.StringType()))
def _feed_column(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        yield pa.array([feed_urls(x or "") for x in part.to_pylist()], type=pa.list_(pa.string()))


def discovered(feeds: DataFrame) -> DataFrame:
    """feeds: feed, body. feed, position, url, canonical_url: each canonical address once, where it comes first."""
    rows = feeds.select("feed", F.posexplode(_feed_column("body")).alias("position", "url")).withColumn("canonical_url", canonical_column("url"))
    w = Window.partitionBy("canonical_url").orderBy("feed", "position")
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """What was found and not seen before, by canonical address."""
    return found.join(seen.select("canonical_url"), "canonical_url", "left_anti")


# ---- job boards --------------------------------------------------------------------------------------------------------------

_BOARDS = {
    "greenhouse": ("jobs", {"title": "title", "url": "absolute_url", "location": "location.name", "published_at": "updated_at"}),
    "lever": ("", {"title": "text", "url": "hostedUrl", "location": "categories.location", "published_at": "createdAt"}),
    "ashby": ("jobs", {"title": "title", "url": "jobUrl", "location": "location", "published_at": "publishedAt"}),
}


def board_listings(bodies: DataFrame, board: str) -> DataFrame:
    """bodies: company, body (a board's JSON). company, title, url, location, published_at, source."""
    at, names = _BOARDS[board]
    items = F.from_json(F.get_json_object("body", f"$.{at}" if at else "$"), T.ArrayType(T.StringType()))
    rows = bodies.select("company", F.explode(items).alias("item"))
    return rows.select("company", *[F.get_json_object("item", f"$.{path}").alias(n) for n, path in names.items()], F.lit("ats").alias("source"))


def listing_details(pages: DataFrame) -> DataFrame:
    """pages: url, html of job postings. title, company, location, description by their marked elements."""
    text = lambda name, cls: F.trim(F.regexp_replace(F.regexp_extract("html", rf'(?s)<[^>]*class="[^"]*{cls}[^"]*"[^>]*>(.*?)</', 1), r"<[^>]+>", " ")).alias(name)
    return pages.select("url", text("title", "topcard__title"), text("company", "topcard__org-name-link"), text("location", "topcard__flavor--bullet"), text("description", "description__text"))
