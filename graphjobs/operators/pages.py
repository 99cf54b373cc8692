"""Web pages to articles."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is dropped with all it holds, and where the text is looked for, in order.
DROPPED_TAGS = frozenset(("script", "style", "noscript", "iframe", "header", "footer", "nav", "aside", "svg"))
DROPPED_CLASSES = frozenset(("ads", "advertisement"))
CONTAINERS = ("article", ".article-content", ".post-body", ".main-content", "#content", "body")
#: Elements that have no end tag.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements whose text stays on a line with its neighbours.
INLINE = frozenset(("a", "abbr", "b", "cite", "code", "em", "font", "i", "kbd", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"))


class _Reader(HTMLParser):
    """Collects the text of the first element of each kind of container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[int, ...], bool]] = []
        self.texts: dict[int, list[str]] = {}
        self.closed: set[int] = set()

    def _kinds(self, tag: str, attrs: dict) -> tuple[int, ...]:
        names = {tag, *("." + c for c in (attrs.get("class") or "").split()), "#" + (attrs.get("id") or "")}
        return tuple(i for i, c in enumerate(CONTAINERS) if c in names and i not in self.texts)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag not in INLINE:
            self._add("\n")
        if tag in VOID:
            return
        hidden = bool(self.stack and self.stack[-1][2]) or tag in DROPPED_TAGS or not DROPPED_CLASSES.isdisjoint((attrs.get("class") or "").split())
        kinds = () if hidden else self._kinds(tag, attrs)
        for k in kinds:
            self.texts[k] = []
        self.stack.append((tag, kinds, hidden))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            for _, kinds, _ in self.stack[at:]:
                self.closed.update(kinds)
            del self.stack[at:]
        if tag not in INLINE:
            self._add("\n")

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]):
            self._add(" ".join(data.split("\n")))

    def _add(self, text: str):
        for k in self.texts.keys() - self.closed:
            self.texts[k].append(text)


def main_text(html: str | None) -> str:
    """Lines of visible text of the best container; empty if there is none."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    best = next((k for k in range(len(CONTAINERS)) if k in reader.texts), None)
    if best is None:
        return ""
    lines = (x.strip() for x in "".join(reader.texts[best]).split("\n"))
    return "\n".join(x for x in lines if x)


def html_main_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in pages], dtype=object)

    return read(html)


def filter_urls(pages: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """Rows with a URL that starts with http, each URL once, where it came first; of rows
    with equal URL and place the least one. One aggregation moves each row once at most."""
    web = pages.filter(F.col(url).startswith("http"))
    rest = [c for c in pages.columns if c not in (url, pos)]
    first = web.groupBy(url).agg(F.min_by(F.struct(pos, *rest), F.struct(pos, F.xxhash64(*rest) if rest else F.lit(0))).alias("_first"))
    return first.select(*[F.col(url) if c == url else F.col(f"_first.{c}") for c in pages.columns])


def pages_to_articles(pages: DataFrame, min_chars: int = 100, limit: int | None = None) -> DataFrame:
    """(url, title, content, pos) of pages (url, html, pos) with more than min_chars of
    text; a limit keeps the first ones by pos."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = pages.select("url", title.alias("title"), html_main_text(F.col("html")).alias("content"), "pos").filter(F.length("content") > min_chars)
    return rows.orderBy("pos").limit(limit) if limit else rows
