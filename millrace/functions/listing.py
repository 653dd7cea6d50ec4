"""Fields derived from listings, answers and log events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import compact_text, normalize_text


def primary_url(sources: Column) -> Column:
    """First application URL of sources array<struct<url,application_url,...>>, else the first URL, else ''."""
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.coalesce(F.get(F.filter(sources, lambda s: some(s["application_url"])), F.lit(0))["application_url"], F.get(F.filter(sources, lambda s: some(s["url"])), F.lit(0))["url"], F.lit(""))


def place_text(locations: Column, missing: str = "unknown") -> Column:
    return F.coalesce(F.nullif(F.array_join(F.filter(locations, lambda x: x != ""), ", "), F.lit("")), F.lit(missing))


def employment_text(values: Column) -> Column:
    """A list of employment types as text; empty ones go."""
    return F.array_join(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), ", ")


def display_remote(percent: Column, mode: Column) -> Column:
    return F.when(percent.isNotNull(), F.format_string("%d%%", percent)).when(mode == "remote", "100%").when(mode == "hybrid", "hybrid").when(mode == "onsite", "0%").otherwise("unknown")


def role_label(role: Column, labels: dict[str, str]) -> Column:
    """Label of a role, or its id with spaces."""
    known = F.coalesce(*[F.when(role == k, v) for k, v in labels.items()]) if labels else F.lit(None).cast("string")
    return F.coalesce(known, F.replace(role, F.lit("_"), F.lit(" ")))


def route_destination(locations: Column, generic: Iterable[str]) -> Column:
    """First place that can be driven to: parts at commas, without what is only a country or a way of working."""
    parts = F.flatten(F.transform(locations, lambda x: F.transform(F.split(x, ","), lambda p: F.trim(p))))
    dull = F.array(*[F.lit(g) for g in generic])
    return F.get(F.filter(parts, lambda p: (p != "") & ~F.array_contains(dull, normalize_text(p))), F.lit(0))


def appointment_time(status: Column, value: Column, appointments: Iterable[str] = ("interview", "trial_day")) -> Column:
    """Time without zone of an appointment (yyyy-MM-ddTHH:mm); null for other statuses and for what can't be read."""
    return F.when(status.isin(*appointments), F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz"))


def retry_after(seconds: Column, least: int = 5, most: int = 65) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(seconds.try_cast("double"), F.lit(least))))


def local_date(at: Column, zone: str = "Europe/Berlin") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def run_label(at: Column, now: Column, zone: str = "Europe/Berlin") -> Column:
    """today hh:mm, yesterday hh:mm or the date, in a zone."""
    local, ref = F.from_utc_timestamp(at, zone), F.from_utc_timestamp(now, zone)
    days = F.date_diff(ref, local)
    clock = F.date_format(local, "HH:mm")
    return F.when(days == 0, F.concat(F.lit("today "), clock)).when(days == 1, F.concat(F.lit("yesterday "), clock)).otherwise(F.date_format(local, "dd.MM.yyyy"))


def urls_in(text: Column) -> Column:
    """Distinct URLs of a text, without the marks a sentence leaves at their ends."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[/.,;:)]+$", "")))


def verified(claimed: Column, seen: Column) -> Column:
    """Claimed URLs that were seen, once each, compared without the marks at their ends."""
    plain = lambda u: F.regexp_replace(u, r"[/.,;:)]+$", "")
    known = F.transform(seen, plain)
    return F.array_distinct(F.filter(claimed, lambda u: F.array_contains(known, plain(u))))


def money_in(text: Column) -> Column:
    """Whether normalised text names an amount of money."""
    return text.rlike(r"\d[\d.,\s]*k?\s*(?:eur|euro|€)|(?:eur|euro|€)\s*\d")


def usage_of(answer: Column, searches: Column) -> Column:
    """struct(input, cached, output, searches) of an answer in JSON; missing counts are 0, and without a count of its own
    the searches billed elsewhere count."""
    v = F.try_parse_json(answer)
    n = lambda path: F.coalesce(F.try_variant_get(v, path, "long"), F.lit(0).cast("long"))
    return F.struct(n("$.usage.input_tokens").alias("input"), n("$.usage.input_tokens_details.cached_tokens").alias("cached"), n("$.usage.output_tokens").alias("output"), F.coalesce(F.try_variant_get(v, "$.usage.web_searches", "long"), searches, F.lit(0)).cast("long").alias("searches"))


def safe_attributes(attributes: Column, allowed: Iterable[str]) -> Column:
    names = F.array(*[F.lit(a) for a in allowed])
    return F.map_filter(attributes, lambda k, v: F.array_contains(names, k) & v.isNotNull())


LIGHTS = ("gruen", "gelb", "rot", "unbekannt")
VERDICTS = ("bewerben", "erst_klaeren", "eher_streichen", "streichen")
SHEET = "lines map<string,struct<light:string,text:string>>, extras array<struct<topic:string,light:string,text:string>>, verdict struct<level:string,text:string>, reason string, sources array<string>"


def fact_sheet(text: Column, lines: Iterable[str], lights: Iterable[str] = LIGHTS, verdicts: Iterable[str] = VERDICTS) -> Column:
    """struct(sheet, error): a sheet parsed strictly from JSON, its extras cut to two; or the first rule it breaks: no
    JSON, a line missing or unknown, a light or verdict that is none, or an empty text."""
    sheet = F.from_json(text, SHEET, {"mode": "PERMISSIVE"})
    names, ok_lights = F.array(*[F.lit(x) for x in lines]), F.array(*[F.lit(x) for x in lights])
    there = F.map_keys(sheet["lines"])
    blank = lambda c: F.coalesce(compact_text(c), F.lit("")) == ""
    values = F.map_values(sheet["lines"])
    error = (
        F.when(sheet.isNull() | sheet["lines"].isNull() | sheet["verdict"].isNull(), "not a sheet")
        .when(F.size(F.array_except(names, there)) > 0, "line missing")
        .when(F.size(F.array_except(there, names)) > 0, "unknown line")
        .when(F.exists(values, lambda x: ~F.coalesce(F.array_contains(ok_lights, x["light"]), F.lit(False))), "unknown light")
        .when(F.exists(values, lambda x: blank(x["text"])), "text missing")
        .when(~F.coalesce(sheet["verdict"]["level"].isin(*verdicts), F.lit(False)), "unknown verdict")
        .when(blank(sheet["verdict"]["text"]), "text missing")
    )
    kept = F.struct(sheet["lines"].alias("lines"), F.slice(F.coalesce(sheet["extras"], F.array().cast("array<struct<topic:string,light:string,text:string>>")), 1, 2).alias("extras"), sheet["verdict"].alias("verdict"), sheet["reason"].alias("reason"), F.array_distinct(F.coalesce(sheet["sources"], F.array().cast("array<string>"))).alias("sources"))
    return F.struct(F.when(error.isNull(), kept).alias("sheet"), error.alias("error"))
