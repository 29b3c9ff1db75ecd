"""Main text of HTML pages, by block structure. An approximation of full readability extractors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIPPED = frozenset("script style noscript template svg nav footer aside header form iframe button select".split())
_BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol table tr blockquote pre br hr body title td th figure figcaption".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.in_title = [], False
        self.title, self.blocks, self.now = [], [], []
        self.meta: dict[str, str] = {}

    def _close(self):
        text = re.sub(r"\s+", " ", "".join(self.now)).strip()
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag == "html" and at.get("lang"):
            self.meta["language"] = at["lang"]
        elif tag == "link" and at.get("rel", "").lower() == "canonical":
            self.meta["canonical"] = at.get("href", "")
        elif tag == "meta" and (at.get("property") or at.get("name")) in ("article:published_time", "date"):
            self.meta["published"] = at.get("content", "")
        if tag in _SKIPPED:
            self.skip.append(tag)
        self.in_title = tag == "title" or (self.in_title and tag in _VOID)
        if tag in _BLOCKS:
            self._close()

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip and self.skip.pop() != tag:
                pass
        if tag == "title":
            self.in_title = False
        if tag in _BLOCKS:
            self._close()

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.now.append(data)


def extract(html: str | None) -> tuple[str, str, dict[str, str]]:
    """Title, text (a line a block) and metadata; empty for null."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close()
    return re.sub(r"\s+", " ", "".join(reader.title)).strip(), "\n".join(reader.blocks), reader.meta


_KIND = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "text", "language", "canonical", "published")])


@F.arrow_udf(_KIND)
def _extracted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        rows = [extract(x) for x in part.to_pylist()]
        columns = [[r[0] for r in rows], [r[1] for r in rows], *[[r[2].get(n) for r in rows] for n in ("language", "canonical", "published")]]
        yield pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["title", "text", "language", "canonical", "published"])


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, text, language, canonical and published, taken from a column of HTML."""
    return pages.withColumn("__x", _extracted(F.col(html))).select(*pages.columns, "__x.*")
