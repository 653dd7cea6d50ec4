"""Structured data in pages: JSON-LD postings, embedded state, XML feeds, and the mapping to listings."""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import text_of_html

_SCRIPT = re.compile(r"<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.IGNORECASE | re.DOTALL)


def find_typed(data, kind: str = "JobPosting") -> dict | None:
    """First object of a type anywhere in a JSON value, outer before inner, in order."""
    waiting = [data]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            types = x.get("@type")
            if types == kind or isinstance(types, list) and kind in types:
                return x
            waiting += reversed(list(x.values()))
        elif isinstance(x, list):
            waiting += reversed(x)
    return None


def posting_of(page: str | None, kind: str = "JobPosting") -> dict | None:
    """Posting in a page's JSON-LD; scripts are read leniently, and once more with entities resolved."""
    for script in _SCRIPT.findall(page or ""):
        for text in (script, html_lib.unescape(script)):
            try:
                found = find_typed(json.loads(text, strict=False), kind)
            except ValueError:
                continue
            if found:
                return found
    return None


def _many(value) -> list[str]:
    return [str(v).strip() for v in (value if isinstance(value, list) else [value]) if v not in (None, "") and str(v).strip()]


def _places(posting: dict) -> list[str]:
    out = []
    for place in posting.get("jobLocation") if isinstance(posting.get("jobLocation"), list) else [posting.get("jobLocation")]:
        address = place.get("address") if isinstance(place, dict) else None
        if isinstance(address, dict):
            out += _many(address.get("addressLocality") or address.get("addressRegion"))
        else:
            out += _many(address)
    return list(dict.fromkeys(out))


def yearly_salary(posting: dict) -> tuple[int | None, int | None]:
    """(least, most) in whole euros a year; other currencies and periods give none."""
    base = posting.get("baseSalary")
    if not isinstance(base, dict) or str(base.get("currency", "")).upper() != "EUR":
        return None, None
    value = base.get("value")
    if not isinstance(value, dict):
        value = {"value": value, "unitText": "YEAR"}
    if str(value.get("unitText", "")).upper() not in ("YEAR", "YEARLY", "ANNUAL"):
        return None, None

    def number(x) -> int | None:
        try:
            return round(float(x)) if float(x) > 0 else None
        except (TypeError, ValueError):
            return None

    low, high = number(value.get("minValue", value.get("value"))), number(value.get("maxValue", value.get("value")))
    return (low, high) if low is None or high is None or low <= high else (high, low)


LISTING = "title string, company string, locations array<string>, description string, employment string, published string, identifier string, salary_min long, salary_max long"


def listing_of(posting: dict) -> tuple:
    company = posting.get("hiringOrganization")
    ident = posting.get("identifier")
    low, high = yearly_salary(posting)
    return (
        str(posting.get("title") or "").strip(),
        str((company.get("name") if isinstance(company, dict) else company) or "").strip(),
        _places(posting),
        text_of_html(str(posting.get("description") or "")),
        ", ".join(_many(posting.get("employmentType"))),
        str(posting.get("datePosted") or "")[:10],
        str((ident.get("value") if isinstance(ident, dict) else ident) or "").strip(),
        low,
        high,
    )


def postings(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, listing fields) of the pages that carry a posting; the others give no row."""
    names = [c.split()[0] for c in LISTING.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *listing_of(p)) for i, page in zip(f[id_col], f[html_col]) if (p := posting_of(page))]
            out = pd.DataFrame(rows, columns=[id_col, *names])
            for c in ("salary_min", "salary_max"):
                out[c] = out[c].astype("Int64")
            yield out

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(read, f"`{id_col}` {kind}, {LISTING}")


def script_json(html: Column, script_id: str) -> Column:
    """The text of a script element by its id, as a variant; null where it is not JSON."""
    body = F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{re.escape(script_id)}"[^>]*>(.*?)</script>', 1)
    return F.try_parse_json(F.nullif(body, F.lit("")))


def feed_items(feeds: DataFrame, xml_col: str, row_tag: str, ddl: str) -> DataFrame:
    """Items of XML feeds held in a column: each item is cut out and parsed by itself, so a broken one costs only itself."""
    items = feeds.select(*[c for c in feeds.columns if c != xml_col], F.explode(F.regexp_extract_all(xml_col, F.lit(rf"(?s)(<{row_tag}[ >].*?</{row_tag}>)"), F.lit(1))).alias("__x"))
    parsed = items.withColumn("__p", F.from_xml("__x", ddl, {"mode": "PERMISSIVE"}))
    keep = [c for c in feeds.columns if c != xml_col]
    return parsed.select(*keep, "__p.*")
