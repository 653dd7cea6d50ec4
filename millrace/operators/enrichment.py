"""Late details: fetched or cached detail rows merged into the listings that passed the first rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numbers as N

LEAST_TEXT = 200


def due_for_detail(listings: DataFrame, candidates: DataFrame, cache: DataFrame, source: str, now: Column, hours: float) -> DataFrame:
    """Listings(id, sources array<struct<source,url>>) among candidates(id) whose first source is the given one and whose
    url has no fresh row in cache(url, fetched_at): only these are fetched, after the rules have thinned the rest out."""
    first = F.get("sources", F.lit(0))
    mine = listings.join(candidates.select("id"), "id", "left_semi").where(first["source"] == source).withColumn("url", first["url"])
    fresh = cache.where(N.is_fresh(F.col("fetched_at"), now, hours)).select("url")
    return mine.join(fresh, "url", "left_anti")


def with_details(listings: DataFrame, details: DataFrame, source: str, carried: list[str]) -> DataFrame:
    """Listings with their detail rows, by id: a detail replaces the values of its listing but for the columns in
    `carried` (state of the run), and keeps what other sources gave: their links after its own, and their places.

    Both have id, locations and sources; a listing without a detail stays as it is. details may hold a row once an id.
    """
    own = [c for c in listings.columns if c != "id"]
    d = details.select("id", F.struct(*[c for c in details.columns if c != "id"]).alias("__d"))
    j = listings.join(d, "id", "left")
    others = F.filter("sources", lambda s: s["source"] != source)
    merged = {
        "sources": F.array_union(F.col("__d.sources"), others),
        "locations": F.when(F.size(others) > 0, F.array_distinct(F.concat("__d.locations", "locations"))).otherwise(F.array_distinct("__d.locations")),
    }
    found = F.col("__d").isNotNull()
    new = lambda c: F.col(c) if c in carried or c not in details.columns else F.when(found, merged.get(c, F.col(f"__d.{c}"))).otherwise(F.col(c))
    return j.select("id", *[new(c).alias(c) for c in own])


def enrichment_report(due: DataFrame, details: DataFrame, hooks: list[str]) -> DataFrame:
    """(name, enriched, failed) of each hook, also of those that had nothing to do: of the candidates due(source, id) how many
    got a row of details(source, id), once each, and how many did not."""
    got = details.select(F.col("source").alias("name"), "id").distinct().withColumn("__got", F.lit(True))
    counts = due.select(F.col("source").alias("name"), "id").distinct().join(got, ["name", "id"], "left").groupBy("name").agg(F.count("__got").alias("enriched"), F.count_if(F.col("__got").isNull()).alias("failed"))
    named = due.sparkSession.createDataFrame([(h,) for h in dict.fromkeys(hooks)], "name string")
    return named.join(counts, "name", "left").na.fill(0, ["enriched", "failed"])


def with_current_summary(cached: DataFrame, summaries: DataFrame, unknown_place: str = "unknown") -> DataFrame:
    """Cached details(id, title, company, locations, sources, ...) under what the summary of this run says: its title and
    company unless empty, its places unless unknown, its sources always. Rows without a summary go."""
    s = summaries.select("id", *[F.col(c).alias(f"__{c}") for c in ("title", "company", "locations", "sources")])
    j = cached.join(s, "id")
    said = {c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)) for c in ("title", "company")}
    said["locations"] = F.when(F.col("__locations").eqNullSafe(F.array(F.lit(unknown_place))), F.col("locations")).otherwise(F.col("__locations"))
    said["sources"] = F.col("__sources")
    return j.select(*[said.get(c, F.col(c)).alias(c) for c in cached.columns])


def external_text(structured: Column, others: Column, least: int = LEAST_TEXT) -> Column:
    """A page's structured text if it is long enough, else the longest of its other texts (the first of equal ones)."""
    longest = F.reduce(others, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(F.length(structured) >= least, structured).otherwise(longest)


def first_present(payload: Column, *paths: str) -> Column:
    """The first of several places in a JSON document that holds a value."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths])


def labelled_flags(flags: list[tuple[Column, str]], otherwise: Column) -> Column:
    """Labels of the flags that are set, joined; the other value where none is."""
    said = F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in flags])), ", ")
    return F.coalesce(F.nullif(said, F.lit("")), otherwise)


def latest_checks(checks: DataFrame) -> DataFrame:
    """The newest of checks(url, closed, checked_at) for each url; one that proves nothing (closed null) does not count."""
    w = Window.partitionBy("url").orderBy(F.desc("checked_at"), F.desc("closed"))
    return checks.where("closed is not null").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def drop_closed(cards: DataFrame, checks: DataFrame, source: str, now: Column, hours: float = 24) -> DataFrame:
    """Cards(id, sources array<struct<source,url,application_url>>) without the listings of `source` whose application
    page a fresh check found closed; a card that has no listing left goes."""
    closed = latest_checks(checks).where(F.col("closed") & N.is_fresh(F.col("checked_at"), now, hours)).select(F.col("url").alias("__url"))
    target = F.filter("sources", lambda s: (s["source"] == source) & (F.trim(s["application_url"]) != ""))
    asked = cards.select("id", F.explode(F.transform(target, lambda s: F.trim(s["application_url"]))).alias("__url")).join(closed, "__url")
    gone = asked.groupBy("id").agg(F.collect_set("__url").alias("__gone"))
    j = cards.join(gone, "id", "left")
    stays = lambda s: ~((s["source"] == source) & F.coalesce(F.array_contains("__gone", F.trim(s["application_url"])), F.lit(False)))
    return j.withColumn("sources", F.when(F.col("__gone").isNull(), F.col("sources")).otherwise(F.filter("sources", stays))).where("size(sources) > 0").select(*cards.columns)


def closed_by_page(final_url: Column, text: Column, own_id: Column, final_id: Column, host: str, markers: list[str]) -> Column:
    """Whether a job's page is closed: it leads to another job or to the search, or says so. Null where the answer proves
    nothing (another site, a sign-in page)."""
    on_host = F.lower(F.parse_url(final_url, F.lit("HOST"))).rlike(rf"(^|\.){host}$")
    path = F.regexp_replace(F.lower(F.parse_url(final_url, F.lit("PATH"))), "/+$", "")
    says = F.lit(False)
    for m in markers:
        says = says | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(m))
    moved = (F.coalesce(own_id, F.lit("")) != "") & (own_id != final_id)
    to_search = F.startswith(path, F.lit("/jobs")) & ~F.startswith(path, F.lit("/jobs/view"))
    return F.when(F.coalesce(on_host, F.lit(False)), F.when(F.coalesce(final_id, F.lit("")) != "", moved | says).when(to_search, True))
