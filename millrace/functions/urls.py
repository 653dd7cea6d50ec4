"""URLs and identifiers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track (fixed values).
TRACKING_PREFIX = "utm_"
TRACKING_NAMES = ("fbclid", "gclid", "msclkid")


def canonical_url(url: Column) -> Column:
    """The URL without fragment and without tracking parameters; others keep their order and spelling."""
    bare = F.substring_index(url, "#", 1)
    base = F.substring_index(bare, "?", 1)
    query = F.when(F.contains(bare, F.lit("?")), F.substring(bare, F.length(base) + 2, F.length(bare))).otherwise(F.lit(""))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(name(p), F.lit(TRACKING_PREFIX)) & ~name(p).isin(*TRACKING_NAMES))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def bare_url(url: Column) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.regexp_replace(F.substring_index(F.substring_index(url, "#", 1), "?", 1), "/+$", "")


def comparable_url(url: Column) -> Column:
    """Without the marks that a sentence leaves at a URL's end."""
    return F.regexp_replace(url, r"[/.,;:)]+$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def identifier_from_url(url: Column) -> Column:
    """Last path part; a number at its end if there is one."""
    tail = F.element_at(F.split(bare_url(url), "/"), -1)
    number = F.regexp_extract(tail, r"(\d+)$", 1)
    return F.when(number != "", number).otherwise(tail)


def stable_id(source: Column, external: Column, url: Column) -> Column:
    """source:external, or where there is no external id, source: and 20 hex digits of the URL's SHA-256."""
    own = F.nullif(F.trim(F.coalesce(external.cast("string"), F.lit(""))), F.lit(""))
    return F.concat_ws(":", source, F.coalesce(own, F.substring(F.sha2(url, 256), 1, 20)))


def links(html: Column, pattern: str = r'href="([^"#]+)"') -> Column:
    """Distinct link targets in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def absolute(link: Column, base: Column) -> Column:
    """A link against its page's URL: absolute ones stay, /x goes to the host, anything else to the page's folder."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.substring_index(F.substring_index(base, "#", 1), "?", 1), r"(?<![:/])/[^/]*$", "")
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(F.concat(folder, F.lit("/"), link))
