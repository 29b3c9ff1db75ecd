"""Main text of HTML pages: blocks are weighed by their words and links, and the element whose blocks weigh most is the article.

A page is read once, tag by tag, with a stack of the open block elements; nothing recurses, and the work is linear in the page.

* A block is the text between two block tags. Its weight is its words, less `LINK_COST` for each linked word and `BLOCK_COST` for the
  block itself, so that lists of links and scattered labels weigh less than nothing. Headings cost nothing.
* Navigation, asides, footers, page headers, and elements whose class, id or role says advertisement, comments and the like are
  furniture: their blocks weigh less than nothing and are never given out.
* An element weighs what its blocks weigh; in an `article`, `main` or the like blocks cost nothing, and one
  with more words outside links than in them gets a bonus. The heaviest element is taken, the innermost
  of equal ones; so a wrapper that adds a menu to an article loses to the article, and one that adds a second part wins.
* Of it, the blocks that are not furniture and not mostly links are the text, a line each; cells of a row of a table share a line.
* Where so little is found that it is less than `FALLBACK_SHARE` of the words outside menus and footers, all blocks that are not mostly links
  are given, furniture by its tag left out: a page is rather given whole than lost.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINK_COST, BLOCK_COST, FURNITURE_COST, BONUS = 3.0, 3.0, 3.0, 25.0
MOST_LINKED, FALLBACK_SHARE = 0.5, 0.1

_UNSEEN = frozenset("script style noscript template svg iframe button select textarea object head".split())
_BLOCKS = frozenset("html body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset nav aside header footer center details summary address".split())
_BREAKS = frozenset("br hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset("td th".split())
_FURNITURE = frozenset("nav aside footer".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog".split())
_ARTICLES = frozenset("article main".split())
_NAMES = frozenset(
    "ad ads advert advertisement adsense sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus share sharing social related recommended "
    "recommendations cookie cookies consent gdpr newsletter subscribe popup modal overlay pagination pager widget widgets toolbar tags masthead skip".split()
)
#: An element that begins ends the open ones that it cannot be in, up to the nearest of the second set.
_ENDS = {
    "li": (frozenset(["li", "p"]), frozenset("ul ol".split())),
    "dt": (frozenset("dt dd p".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd p".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th p".split()), frozenset(["table"])),
    "td": (frozenset("td th p".split()), frozenset("tr table".split())),
    "th": (frozenset("td th p".split()), frozenset("tr table".split())),
}
_PARAGRAPH = (frozenset(["p"]), frozenset("td th li dd table".split()))
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(slots=True)
class _Element:
    tag: str
    furniture: bool
    hard: bool
    article: bool
    inside: bool  # of an article, itself included
    first: int
    weight: float = 0.0
    unlinked: int = 0  # words outside links, less those in them


@dataclass(slots=True)
class _Block:
    text: str
    words: int
    linked: int
    furniture: bool
    hard: bool
    row: int


@dataclass
class Page:
    title: str = ""
    text: str = ""
    language: str | None = None
    canonical: str | None = None
    published: str | None = None
    author: str | None = None
    facts: dict[str, str] = field(default_factory=dict, repr=False)


def _named_furniture(at: dict[str, str]) -> bool:
    if at.get("role", "").strip().lower() in _ROLES or at.get("aria-hidden") == "true" or "hidden" in at:
        return True
    return any(part.lower() in _NAMES for part in _NAME_PARTS.findall(at.get("class", "") + " " + at.get("id", "")))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", False, False, False, False, 0)]
        self.open = Counter()  # tags on the stack
        self.blocks: list[_Block] = []
        self.best = (float("-inf"), 0, 0)
        self.unseen: list[str] = []
        self.plain: list[str] = []
        self.links: list[str] = []
        self.link_depth = 0  # of the stack where a link began; 0 outside links
        self.rows = 0
        self.row = 0  # of the table row that is open, else 0
        self.title: list[str] = []
        self.heading: list[str] = []
        self.in_title = self.in_heading = self.in_json = False
        self.facts: dict[str, str] = {}

    # ---- blocks ------------------------------------------------------------------------------------------------------

    def _flush(self) -> None:
        text = " ".join("".join(self.plain).split())
        linked = min(len("".join(self.links).split()), len(text.split()))
        self.plain, self.links = [], []
        if not text:
            return
        top, words = self.stack[-1], len(text.split())
        if top.furniture:
            top.weight -= FURNITURE_COST + words / 2
        else:
            top.weight += words - LINK_COST * linked - (0.0 if top.tag in _HEADINGS or top.inside else BLOCK_COST)
            top.unlinked += words - 2 * linked
        self.blocks.append(_Block(text, words, linked, top.furniture, top.hard, self.row))

    def _open(self, tag: str, at: dict[str, str]) -> None:
        out = self.stack[-1]
        article = tag in _ARTICLES or at.get("role", "").lower() in _ARTICLES or at.get("itemprop") == "articleBody"
        hard = out.hard or tag in _FURNITURE or (tag == "header" and not out.inside)
        furniture = out.furniture or hard or (tag not in ("html", "body") and not article and _named_furniture(at))
        article = article and not furniture
        self.stack.append(_Element(tag, furniture, hard, article, article or out.inside, len(self.blocks)))
        self.open[tag] += 1
        if tag == "tr":
            self.rows += 1
            self.row = self.rows

    def _pop(self) -> None:
        done = self.stack.pop()
        self.open[done.tag] -= 1
        total = done.weight + (BONUS if done.article and done.unlinked > 0 else 0.0)
        if total > self.best[0] and len(self.blocks) > done.first:
            self.best = (total, done.first, len(self.blocks))
        if self.stack:
            self.stack[-1].weight += total
            self.stack[-1].unlinked += done.unlinked
        if done.tag == "tr":
            self.row = 0
        if self.link_depth > len(self.stack):
            self.link_depth = 0

    def _end(self, ended: tuple[frozenset, frozenset]) -> None:
        """Ends the outermost open element of the first set that lies above the nearest of the second."""
        at = None
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in ended[1]:
                break
            if self.stack[k].tag in ended[0]:
                at = k
            elif self.stack[k].tag in ("div", "section", "article", "main", "body", "form"):
                break
        while at is not None and len(self.stack) > at:
            self._pop()

    # ---- events --------------------------------------------------------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        self._note(tag, at)
        if tag == "body":  # a head that was not ended
            self.unseen = []
        if tag in _UNSEEN:
            self.unseen.append(tag)
        elif self.unseen:
            return
        elif tag in _BLOCKS:
            self._flush()
            self._end(_ENDS.get(tag, _PARAGRAPH))
            self._open(tag, at)
            self.in_heading = tag == "h1" and not self.heading
        elif tag in _BREAKS:
            self.plain.append(" ")
            self.links.append(" ")
        elif tag == "a" and at.get("href"):
            self.link_depth = len(self.stack)
        elif tag == "img":
            self.plain.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _BLOCKS or tag in _UNSEEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        self.in_json = self.in_json and tag != "script"
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
            return
        if tag == "a":
            self.link_depth = 0
        elif tag in _BLOCKS:
            self._flush()
            self.in_heading = self.in_heading and tag != "h1"
            if self.open[tag]:
                while self._top_after_pop() != tag:
                    pass

    def _top_after_pop(self) -> str:
        tag = self.stack[-1].tag
        self._pop()
        return tag

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif self.in_json:
            self._note_json(data)
        elif not self.unseen:
            self.plain.append(data)
            self.links.append(data if self.link_depth else " ")
            if self.in_heading:
                self.heading.append(data)

    # ---- facts -----------------------------------------------------------------------------------------------------------

    def _note(self, tag: str, at: dict[str, str]) -> None:
        say = self.facts.setdefault
        if tag == "title" and not self.title and "svg" not in self.unseen:
            self.in_title = True
        elif tag == "html" and at.get("lang"):
            say("lang", at["lang"].strip())
        elif tag == "link" and "canonical" in at.get("rel", "").lower().split() and at.get("href"):
            say("canonical", at["href"].strip())
        elif tag == "meta" and at.get("content"):
            name = (at.get("property") or at.get("name") or at.get("itemprop") or at.get("http-equiv") or "").lower()
            if name:
                say(name, at["content"].strip())
        elif tag == "time" and at.get("datetime"):
            say("time", at["datetime"].strip())
        elif tag == "script" and at.get("type", "").lower() == "application/ld+json":
            self.in_json = True

    def _note_json(self, data: str) -> None:
        try:
            said = json.loads(data)
        except (ValueError, RecursionError):
            return
        graph = said.get("@graph", said) if isinstance(said, dict) else said
        for node in graph if isinstance(graph, list) else [graph]:
            if isinstance(node, dict):
                for key in ("datePublished", "headline"):
                    if isinstance(node.get(key), str):
                        self.facts.setdefault("json " + key, node[key].strip())

    # ---- results ------------------------------------------------------------------------------------------------------------

    def page(self) -> Page:
        self._flush()
        while self.stack:
            self._pop()
        _, first, end = self.best
        kept = [b for b in self.blocks[first:end] if not b.furniture and b.linked <= MOST_LINKED * b.words]
        if sum(b.words for b in kept) < FALLBACK_SHARE * sum(b.words for b in self.blocks if not b.hard):
            kept = [b for b in self.blocks if not b.hard and b.linked <= MOST_LINKED * b.words]
        lines: list[str] = []
        row = 0
        for b in kept:
            if b.row and b.row == row:
                lines[-1] += " | " + b.text
            else:
                lines.append(b.text)
            row = b.row
        said = lambda *names: next((self.facts[n] for n in names if self.facts.get(n)), None)
        squeezed = lambda parts: " ".join("".join(parts).split())
        title = squeezed(self.title) or said("og:title", "twitter:title", "json headline") or squeezed(self.heading)
        published = said("article:published_time", "json datePublished", "datepublished", "date", "dc.date", "pubdate", "time")
        published = published if published and _DAY.match(published) else None
        return Page(title, "\n".join(lines), said("lang", "content-language", "og:locale"), said("canonical", "og:url"), published, said("author", "article:author", "dc.creator"), self.facts)


def main_text(html: str | None) -> Page:
    """The page of an HTML document; empty for null, empty or unreadable HTML."""
    reader = _Reader()
    reader.feed((html or "").replace("\0", " "))
    reader.close()
    return reader.page()


_COLUMNS = ("title", "text", "language", "canonical", "published", "author")
_KIND = T.StructType([T.StructField(n, T.StringType()) for n in _COLUMNS])


@F.arrow_udf(_KIND)
def page_struct(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        pages = [main_text(x) for x in part.to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([getattr(p, n) for p in pages], pa.string()) for n in _COLUMNS], list(_COLUMNS))


def with_main_text(pages: DataFrame, html: str = "html", into: str = "page") -> DataFrame:
    """Adds a struct of title, text, language, canonical, published and author, taken from a column of HTML; one row in, one row out."""
    return pages.withColumn(into, page_struct(F.col("`" + html.replace("`", "``") + "`")))
