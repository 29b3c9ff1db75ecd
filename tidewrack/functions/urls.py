"""URL identity: canonical form, registered domain, noise parameters, redirect wrappers.

The canonical form runs over distinct URLs only, as an Arrow function, and is joined back.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query keys that never tell pages apart, and those that do not with some values.
TRACKING_KEYS = frozenset(
    """utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name gclid gclsrc gbraid wbraid dclid fbclid twclid
    msclkid yclid igshid mc_cid mc_eid mkt_tok _hsenc _hsmi _openstat li_fat_id s_kwcid ncid icid pk_campaign pk_kwd pk_source
    pk_medium mtm_campaign mtm_kwd mtm_source mtm_medium ref ref_src ref_url referrer share trk spm amp amp_js_v amp_gsa usqp
    si feature via sref sr_share cmpid s_cid xtor print printable printview srsltid ocid replytocom""".split()
)
VALUE_KEYS = {
    "output": {"amp", "amphtml", "htmlamp", "print", "printable"},
    "preview": {"1", "true", "yes", "on"},
    **{k: {"print", "printable", "printview", "amp", "amphtml"} for k in ("view", "display", "mode", "format")},
    **{k: {"", "1", "01"} for k in ("page", "p", "paged", "pg")},
}
ALIAS_LABELS = ("www", "m", "mobile", "amp")
PATH_ENDINGS = (
    ("/amp", "/amp.html", "/amp.htm", "/index.amp", "/index.amp.html"),
    ("/print", "/print.html", "/print.htm"),
    ("/embed", "/embed.html", "/embed.htm", "/comments", "/comment", "/share", "/shared"),
    ("/trackback", "/feed", "/atom", "/rdf", "/feed.xml", "/atom.xml", "/index.rdf"),
)
MOBILE_SEGMENTS = ("m", "mobile", "lite", "app")
INDEX_NAMES = ("index.html", "index.htm", "index.php", "index.asp", "index.aspx", "index.jsp", "default.html", "default.htm", "default.asp", "default.aspx")

# Hosts whose links carry the page they lead to, with the path they use and the parameters that hold it.
WRAPPERS: tuple[tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]], ...] = (
    (("translate.google.com", "translate.googleusercontent.com"), ("",), ("u",)),
    (("l.facebook.com", "lm.facebook.com"), ("",), ("u",)),
    (("google.com",), ("/url",), ("url", "q")),
    ((".safelinks.protection.outlook.com",), ("",), ("url",)),
    (("duckduckgo.com",), ("/l",), ("uddg",)),
    (("l.instagram.com",), ("",), ("u",)),
    (("linkedin.com",), ("/safety/go", "/redir/redirect"), ("url",)),
    (("out.reddit.com",), ("",), ("url",)),
    (("youtube.com",), ("/redirect",), ("q",)),
    (("slack-redir.net",), ("/link",), ("url",)),
    (("l.wl.co",), ("",), ("u",)),
    (("t.me", "telegram.me"), ("/share/url", "/iv"), ("url",)),
    (("t.umblr.com",), ("/redirect",), ("z",)),
    (("getpocket.com",), ("/redirect",), ("url",)),
    (("pinterest.com",), ("/pin/create", "/offsite"), ("url",)),
    (("flipboard.com", "share.flipboard.com"), ("/bookmarklet", "/share"), ("url",)),
    (("buffer.com", "bufferapp.com"), ("/add", "/compose"), ("url",)),
    (("medium.com",), ("/r/", "/m/redirect", "/redirect"), ("url",)),
)
# Suffixes under which names are registered one label deeper.
DEEP_SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au co.jp ne.jp or.jp ac.jp com.br com.cn com.mx com.tr com.ar co.in co.kr co.nz co.za com.sg com.hk com.tw github.io blogspot.com".split())


def _host(netloc: str) -> str:
    host = netloc.rsplit("@", 1)[-1]
    return host if host.startswith("[") else host.partition(":")[0]


def _bare(host: str) -> str:
    return host.removeprefix("www.")


def _named(host: str, names: tuple[str, ...]) -> bool:
    return any(host.endswith(n) if n.startswith(".") else host == n for n in names)


def _origin(said: str | None, refused: tuple[str, ...]) -> tuple[str, str, str] | None:
    said = (said or "").strip()
    said = "https:" + said if said.startswith("//") else said
    try:
        parts = urlsplit(said)
    except ValueError:
        return None
    if parts.scheme.lower() not in ("http", "https") or not parts.netloc or _named(_bare(_host(parts.netloc.lower())), refused):
        return None
    return parts.netloc.lower(), parts.path or "/", parts.query


def unwrapped(netloc: str, path: str, query: str) -> tuple[str, str, str] | None:
    """Host, path and query of the page that a cache, viewer, archive or redirect link is about; None for other links."""
    host = _bare(_host(netloc))
    low = path.lower()
    amp = [("/c/s/", "/v/s/", "/c/", "/v/")] if host == "cdn.ampproject.org" or host.endswith(".cdn.ampproject.org") else [("/amp/s/", "/amp/")] if host in ("bing.com", "google.com") else []
    for prefixes in amp:
        for prefix in prefixes:
            if low.startswith(prefix):
                inner, _, rest = path[len(prefix) :].partition("/")
                ok = "." in inner and _bare(inner.lower()) not in ("bing.com", "google.com")
                return (inner.lower(), "/" + rest, "") if ok else None
    if host == "web.archive.org":
        m = re.match(r"/web/\d[0-9a-z_*]*/(.+)", path, re.IGNORECASE | re.DOTALL)
        inner = m and re.sub(r"^(https?):/(?!/)", r"\1://", m[1])
        return _origin(inner + ("?" + query if query else ""), ("web.archive.org",)) if m else None
    if host == "href.li":
        return _origin(query, ("href.li",))
    values = {}
    for k, v in parse_qsl(query, keep_blank_values=True):
        if v.strip():
            values.setdefault(k.lower(), v)
    for hosts, paths, keys in WRAPPERS:
        plain = host if host.count(".") == 1 or host in hosts else re.sub(r"^[a-z]{2}\.", "", host)
        if _named(plain, hosts) and any(low.startswith(p) for p in paths):
            return next((o for k in keys if (o := _origin(values.get(k), hosts))), None)
    return None


def without_alias(netloc: str) -> str:
    """Without leading www, m, mobile and amp labels, as long as two labels remain."""
    if netloc.startswith("["):
        return netloc
    labels = netloc.split(".")
    while len(labels) > 2 and labels[0] in ALIAS_LABELS and labels[1]:
        labels = labels[1:]
    return ".".join(labels)


def plain_path(path: str) -> str:
    def without(ending: str) -> str | None:
        for e in (ending, ending + "/"):
            if path.lower().endswith(e) and len(path) > len(e):
                return path[: -len(e)]
        return None

    for k, endings in enumerate(PATH_ENDINGS):
        path = next((p for e in endings if (p := without(e))), path)
        if not k and path.lower().startswith("/amp/") and len(path) > 5:
            path = path[4:]
    path = next((path[len(s) + 1 :] for s in MOBILE_SEGMENTS if path.lower().startswith(f"/{s}/") and len(path) > len(s) + 2), path)
    path = next((p for s in MOBILE_SEGMENTS if (p := without("/" + s))), path)
    path = next((path[: -len(n)] for n in INDEX_NAMES if path.lower().endswith("/" + n)), path) or "/"
    path = re.sub(r"(?<=[^/])\.html?$", "", path, flags=re.IGNORECASE)
    return path[:-1] if len(path) > 1 and path.endswith("/") else path or "/"


def is_noise(key: str, value: str) -> bool:
    key = key.lower()
    return value.strip().lower() in VALUE_KEYS[key] if key in VALUE_KEYS else key in TRACKING_KEYS


def canonical_url(url: str | None) -> str | None:
    """The identity of a URL: https, unwrapped, without aliases, default ports, noise parameters and fragment; null for what is no URL. Idempotent."""
    try:
        parts = urlsplit((url or "").strip())
    except ValueError:
        return None
    if not parts.scheme or not parts.netloc:
        return None
    scheme = {"http": "https"}.get(parts.scheme.lower(), parts.scheme.lower())
    netloc, path, query = parts.netloc.lower().rsplit("@", 1)[-1], parts.path or "/", parts.query
    for _ in range(4):
        inner = unwrapped(netloc, path, query)
        if inner is None:
            break
        netloc, path, query = inner[0].rsplit("@", 1)[-1], inner[1], inner[2]
    netloc = re.sub(r":(80|443)$", "", netloc)
    pairs = sorted((k, v) for k, v in parse_qsl(query, keep_blank_values=True) if not is_noise(k, v))
    before, path = None, path or "/"
    while path != before:
        before, path = path, plain_path(path)
    return urlunsplit((scheme, without_alias(netloc), path, urlencode(pairs), ""))


def domain_of(url: str | None) -> str | None:
    """The registered domain by a short suffix list (an approximation), or the host."""
    try:
        host = _host(urlsplit((url or "").strip()).netloc.lower()).rstrip(".")
    except ValueError:
        return None
    if not host:
        return None
    labels = host.split(".")
    if host.startswith("[") or re.fullmatch(r"[\d.]+", host) or len(labels) < 3:
        return host
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in DEEP_SUFFIXES else labels[-2:])


def is_homepage(url: str | None) -> bool:
    try:
        parts = urlsplit((url or "").strip())
    except ValueError:
        return False
    return bool(parts.netloc) and plain_path(parts.path or "/") == "/" and not parts.query


def is_public_http_url(url: str | None) -> bool:
    """http(s), and no literal private, local or reserved address; names are not looked up."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme.lower() not in ("http", "https") or not host or host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return True


def sitemap_urls(robots: Column) -> Column:
    """The addresses of Sitemap lines, in order, each once."""
    found = F.transform(F.filter(F.split(robots, r"\r?\n"), lambda x: F.trim(x).rlike("(?i)^sitemap\\s*:")), lambda x: F.trim(F.regexp_replace(x, r"(?i)^\s*sitemap\s*:", "")))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def _column(f, kind: T.DataType):
    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([f(x) for x in part.to_pylist()], type=pa.bool_() if isinstance(kind, T.BooleanType) else pa.string())

    return run


canonical_column = _column(canonical_url, T.StringType())
domain_column = _column(domain_of, T.StringType())
homepage_column = _column(is_homepage, T.BooleanType())
public_column = _column(is_public_http_url, T.BooleanType())


def with_canonical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds canonical_url and site, worked out once for each distinct URL."""
    known = df.select(F.col(url).alias("__u")).distinct().select("__u", canonical_column("__u").alias("canonical_url"), domain_column("__u").alias("site"))
    return df.join(known, F.col(url).eqNullSafe(F.col("__u")), "left").drop("__u")


def is_allowed(robots: str | None, url: str, agent: str = "*") -> bool:
    """What a robots.txt says about a URL; all is allowed without one."""
    from urllib.robotparser import RobotFileParser

    parser = RobotFileParser()
    parser.parse((robots or "").splitlines())
    return parser.can_fetch(agent, url)


def robots_column(robots: Column | str, url: Column | str, agent: str = "*") -> Column:
    """is_allowed for tables of (robots.txt, URL); each robots.txt of a batch is parsed once."""

    @F.arrow_udf(T.BooleanType())
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from urllib.robotparser import RobotFileParser

        for texts, addresses in parts:
            parsers: dict[str, RobotFileParser] = {}
            out = []
            for text, address in zip(texts.to_pylist(), addresses.to_pylist()):
                if (text or "") not in parsers:
                    parsers[text or ""] = RobotFileParser()
                    parsers[text or ""].parse((text or "").splitlines())
                out.append(address is not None and parsers[text or ""].can_fetch(agent, address))
            yield pa.array(out, pa.bool_())

    return run(robots, url)
