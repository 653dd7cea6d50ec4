"""Visible parts of pages: lines, headings, labelled values, and signs that a listing is closed."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCKS = {"p", "div", "li", "ul", "ol", "br", "tr", "td", "th", "h1", "h2", "h3", "h4", "section", "article", "main", "header", "footer", "nav", "table", "dt", "dd"}


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.lines: list[str] = []
        self.headings: list[str] = []
        self.meta: dict[str, str] = {}
        self.title = ""
        self._part: list[str] = []
        self._in: list[str] = []

    def _flush(self) -> None:
        line = " ".join("".join(self._part).split())
        self._part = []
        if line:
            self.lines.append(line)
            if any(re.fullmatch("h[1-3]", t) for t in self._in):
                self.headings.append(line)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS or tag == "title":
            self._flush()
        if tag == "meta":
            a = dict(attrs)
            name = a.get("name") or a.get("property")
            if name and a.get("content") and name.lower() not in self.meta:
                self.meta[name.lower()] = a["content"]
        elif tag not in ("br", "img", "input", "link", "hr"):
            self._in.append(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.title = " ".join("".join(self._part).split())
            self._part = []
        elif tag in _BLOCKS:
            self._flush()
        if tag in self._in:
            while self._in and self._in.pop() != tag:
                pass

    def handle_data(self, data):
        if not {"script", "style"} & set(self._in):
            self._part.append(data)


def visible_page(html: str | None) -> dict:
    p = _Visible()
    p.feed(html or "")
    p.close()
    p._flush()
    return {"title": p.title, "lines": p.lines, "headings": p.headings, "meta": p.meta}


def visible(c: Column) -> Column:
    """struct(title, lines, headings, meta) of HTML; Arrow-batched Python."""

    def read(html):
        return pd.DataFrame([visible_page(h) for h in html])

    read.__annotations__ = {"html": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(read, "title string, lines array<string>, headings array<string>, meta map<string,string>")(c)


def labelled_value(lines: Column, labels: list[str]) -> Column:
    """Value after the first line that is, or begins with, a label and a colon: the rest of that line, else the next line."""
    low = [x.lower() for x in labels]
    pattern = r"(?i)^(?:" + "|".join(re.escape(x) for x in low) + r")\s*:?\s*(.*)$"
    at = F.array_min(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(r"(?i)^(?:" + "|".join(re.escape(x) for x in low) + r")\s*(?::|$)")), lambda s: s["i"]))
    rest = F.regexp_extract(F.get(lines, at), pattern, 1)
    return F.when(at.isNotNull(), F.when(rest != "", rest).otherwise(F.get(lines, at + 1)))


def is_closed(status_code: Column, final_url: Column, lines: Column, gone_urls: list[str], phrases: list[str]) -> Column:
    """Evidence that a listing is closed: 404 or 410, a redirect to a search or overview page, or a visible line that is
    one of the phrases. A page that could not be read is no evidence."""
    redirected = F.coalesce(final_url.rlike("|".join(gone_urls)), F.lit(False)) if gone_urls else F.lit(False)
    said = F.exists(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)).isin(*[p.lower() for p in phrases])) if phrases else F.lit(False)
    return F.when(status_code.isin(404, 410), True).when(status_code.between(200, 299), redirected | said).otherwise(False)
