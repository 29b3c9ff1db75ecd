"""Rule-based entities, their counts, trends and company."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.tokens import matches
from tidewrack.functions.windows import bucket, checked_limit

# The dictionaries of the entity rules. Results depend on every entry; Gazetteer takes others.
TICKERS = frozenset(
    """BTC ETH SOL XRP ADA DOGE DOT AVAX LINK UNI AAVE APT SUI INJ ARB OP SEI PEPE BONK WIF TON LTC BCH SHIB ATOM NEAR FIL
    ICP HBAR VET ALGO ETC EOS XTZ XLM TRX AAPL MSFT GOOGL AMZN META TSLA NVDA AMD INTC NFLX SPY QQQ VIX GLD SLV USO JPM
    BAC GS XOM CVX KO PEP WMT DIS BA GE""".split()
)
PLACES = frozenset(
    x.strip()
    for x in """Istanbul, Ankara, Izmir, Tokyo, Osaka, London, New York, Los Angeles, Chicago, Houston, San Francisco, Boston,
    Seattle, Miami, Berlin, Munich, Frankfurt, Paris, Lyon, Marseille, Beijing, Shanghai, Shenzhen, Moscow, Saint Petersburg,
    Dubai, Abu Dhabi, Singapore, Zurich, Geneva, Washington, Seoul, Sydney, Melbourne, Toronto, Vancouver, Montreal, Mumbai,
    Delhi, Bangalore, Sao Paulo, Rio de Janeiro, Mexico City, Johannesburg, Cape Town, Cairo, Nairobi, Lagos, Amsterdam,
    Madrid, Barcelona, Rome, Milan, Vienna, Stockholm, Oslo, Helsinki, Warsaw, Prague, Budapest, Athens, Lisbon, Dublin,
    Brussels, Copenhagen, Buenos Aires, Santiago, Lima, Bogota, Karachi, Dhaka, Jakarta, Bangkok, Manila, Kuala Lumpur,
    Ho Chi Minh City, Taipei, Hong Kong, Riyadh, Doha, Tel Aviv, Kyiv, Turkey, Turkkiye, Germany, France, United Kingdom,
    China, Russia, Japan, India, Brazil, Canada, Australia, Switzerland, Netherlands, Spain, Italy, Poland, Sweden, Norway,
    Ukraine, Iran, Saudi Arabia, United Arab Emirates, Egypt, South Africa, Nigeria, Mexico, Argentina, Chile, Colombia,
    Indonesia, Vietnam, Thailand, South Korea, United States, Portugal, Belgium, Austria, Denmark, Finland, Ireland, Greece,
    Czech Republic, Hungary, Romania, Bulgaria, Croatia, Serbia, Israel, Jordan, Qatar, Kuwait, Oman, Morocco, Tunisia,
    Algeria, Ethiopia, Kenya, Ghana, Pakistan, Bangladesh, Sri Lanka, Malaysia, Philippines, New Zealand""".replace("\n", " ").split(",")
)
ORG_SUFFIXES = frozenset(
    """Inc Corp Corporation Ltd LLC Bank Group Exchange University Fund ETF Agency Association Institute Commission Council
    Union Holdings Labs Technologies Systems Media News Times Post Journal Herald Tribune Reserve Fed Parliament Senate
    Congress Ministry Department Authority Board Committee Foundation Organization Organisation Partnership Company Co Club
    Center Centre School College Hospital Trust Airways Airlines Energy Petroleum Pharma Therapeutics Biosciences Capital
    Ventures Partners Advisors Consulting Research""".split()
)
STARTERS = frozenset(
    """The A An On In At For To Of And Or With By From Into Onto Upon About After Before During Under Over Via Vs This That
    These Those His Her Their Our Your Its It He She They We You I Not But As If When Where Who Whom Which What How All Any
    Some More Most Other New Old High Low Big Small Large First Last Next Every Each Both""".split()
)
HEADLINE_NOUNS = frozenset(
    """Rally Price Prices Market Markets Stock Stocks Shares Rates Rate Deal Deals Record High Low Peak Drop Rise Surge Slump
    Gain Gains Loss Losses Profit Revenue Earnings Report Reports Update Updates News Analysis Outlook Forecast Growth
    Inflation Economy Fed Bond Bonds Yield Yields Oil Gold Dollar Euro Index Indices Fund Funds ETF ETFs Token Tokens Coin
    Coins""".split()
)


@dataclass(frozen=True)
class Gazetteer:
    tickers: frozenset[str] = TICKERS
    places: frozenset[str] = PLACES
    suffixes: frozenset[str] = ORG_SUFFIXES
    starters: frozenset[str] = STARTERS
    nouns: frozenset[str] = HEADLINE_NOUNS
    words: frozenset[str] = field(default=frozenset("the a an this that these new old big high low".split()))


DEFAULT = Gazetteer()
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9'&.-]*")


def _title_spans(words: list[str]) -> Iterator[list[str]]:
    span: list[str] = []
    for w in [*words, ""]:
        if w and w[0].isupper() and w.isalpha():
            span.append(w)
        elif span:
            yield span[:8]
            span = []


def _of_span(span: list[str], g: Gazetteer) -> Iterator[tuple[str, str]]:
    ends = [k for k, w in enumerate(span) if w in g.suffixes]
    for n, k in enumerate(ends):
        first = ends[n - 1] + 1 if n else 0
        yield " ".join([*[w for w in span[first:k] if w not in g.starters][-3:], span[k]]), "ORG"
    for k in range(len(span)):
        for size in range(1, 5):
            part = span[max(0, k - size + 1) : k + 1]
            if len(part) == size and not any(w in g.suffixes for w in part) and " ".join(part) in g.places:
                yield " ".join(part), "PLACE"
                break
    if not ends and 2 <= len(span) <= 3 and span[0] not in g.starters and not any(w in g.nouns or w in g.places for w in span):
        yield " ".join(span[:2]), "PERSON"


def normalize_entity(text: str) -> str:
    small = {"and", "of", "the", "for", "in", "on", "at", "to", "vs", "vs."}
    words = text.split()
    return " ".join(w.lower() if k and w.lower() in small else w.capitalize() if w.islower() else w for k, w in enumerate(words))


def extract_entities(text: str | None, g: Gazetteer = DEFAULT) -> list[tuple[str, str]]:
    """(text, kind) of a text, each once: tickers first, then organisations, places and persons as they appear."""
    text = " ".join((text or "").split())
    upper = text.upper()
    found = [(t, "TICKER") for t in sorted(g.tickers) if t in upper and re.search(rf"(?<![A-Za-z0-9$])\$?{re.escape(t)}(?![A-Za-z0-9])", text, re.IGNORECASE)]
    for span in _title_spans(_WORD.findall(text)):
        for name, kind in _of_span(span, g):
            name = normalize_entity(name)
            if 2 <= len(name) <= 80 and name.lower() not in g.words:
                found.append((name, kind))
    return list(dict.fromkeys(found))


_KIND = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("kind", T.StringType())]))


@F.arrow_udf(_KIND)
def _entities(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    arrow = pa.list_(pa.struct([("entity", pa.string()), ("kind", pa.string())]))
    for part in parts:
        yield pa.array([[{"entity": e, "kind": k} for e, k in extract_entities(x)] for x in part.to_pylist()], type=arrow)


def exploded_entities(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(_entities(text)).alias("e")).select(*keep, "e.*")


def entity_counts(df: DataFrame, limit: int = 100, chars: int | None = None) -> DataFrame:
    """entity, kind, count of documents, over title and text (whole texts, unless chars is given); rows without a title are left out."""
    text = F.concat("title", F.lit("\n"), F.col("text") if chars is None else F.substring("text", 1, chars))
    part = df.filter(text.rlike("[0-9A-Za-z_]"))
    rows = exploded_entities(part, text).groupBy("entity", "kind").agg(F.count("*").alias("count"))
    return rows.orderBy(F.desc("count"), "entity", "kind").limit(checked_limit(limit))


def co_occurrence(df: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    rows = exploded_entities(df.filter(matches(entity)), F.concat("title", F.lit("\n"), "text")).filter(F.lower("entity") != entity.lower())
    return rows.groupBy("entity", "kind").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "entity", "kind").limit(checked_limit(limit, 200))


def entity_trend(df: DataFrame, entity: str, granularity: str = "day") -> DataFrame:
    """bucket, count from the first to the last bucket with the entity, zeros between."""
    counts = df.filter(F.concat("title", F.lit("\n"), "text").isNotNull() & matches(entity)).groupBy(bucket(F.col("fetch_ts"), granularity).alias("bucket")).agg(F.count("*").alias("n"))
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[granularity]
    edge = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).filter("a IS NOT NULL")
    cal = edge.select(F.explode(F.sequence("a", "b", F.expr(step))).alias("bucket"))
    return cal.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("count"))
