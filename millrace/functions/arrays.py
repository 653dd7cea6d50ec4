"""Ordered lists, paired lists, maps and JSON as Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_union(*lists: Column) -> Column:
    """Values of all lists once, in order, without null and ''."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def distinct_by(items: Column, key, ddl: str) -> Column:
    """First item for each key, in order; ddl: the items' type."""
    empty = F.array().cast(f"array<{ddl}>")
    return F.reduce(items, empty, lambda seen, x: F.when(F.exists(seen, lambda y: key(y).eqNullSafe(key(x))), seen).otherwise(F.concat(seen, F.array(x))))


def pairs(first: Column, second: Column, names: tuple[str, str] = ("first", "second")) -> Column:
    """Two lists by place; the shorter one is filled with nulls, places where both are null are left out."""
    zipped = F.arrays_zip(F.coalesce(first, F.array().cast("array<string>")).alias(names[0]), F.coalesce(second, F.array().cast("array<string>")).alias(names[1]))
    return F.filter(zipped, lambda x: x[names[0]].isNotNull() | x[names[1]].isNotNull())


def list_union_pairs(urls: Column, names: Column, more_urls: Column, more_names: Column) -> Column:
    """Pairs (url, name) of both lists; a url's first name stays."""
    every = F.concat(pairs(urls, names, ("url", "name")), pairs(more_urls, more_names, ("url", "name")))
    return distinct_by(every, lambda x: x["url"], "struct<url:string,name:string>")


def split_record(record: Column, typed: Iterable[str]) -> Column:
    """A map<string,string> record as struct(present, extra): the typed keys that are there (null values included), and
    the other entries."""
    names = F.array(*[F.lit(x) for x in typed])
    return F.struct(F.array_sort(F.array_intersect(F.map_keys(record), names)).alias("present"), F.map_filter(record, lambda k, _: ~F.array_contains(names, k)).alias("extra"))


def join_record(present: Column, typed: Column, extra: Column) -> Column:
    """Inverse of split_record: typed is a map of the typed columns' values."""
    return F.map_concat(F.map_filter(typed, lambda k, _: F.array_contains(present, k)), extra)


def digest(*parts: Column, length: int = 12) -> Column:
    """Hex digest of values in a fixed order; null and '' differ."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), 1, length)


def first_where(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def text_values(c: Column) -> Column:
    """Parts of a text at commas, semicolons, slashes or bars, trimmed; empty ones are dropped."""
    return F.filter(F.transform(F.split(c, r"[,;/|]"), lambda x: F.trim(x)), lambda x: x != "")
