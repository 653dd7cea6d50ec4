"""A whole run: listings of all sources are fetched, merged, scored, held against the state and published as one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import cards, commits, resolve, rules, state
from millrace.session import written
from millrace.sources import union

LINKS = "array<struct<source:string,url:string>>"
LISTINGS = f"id string, ord long, title string, company string, locations array<string>, sources {LINKS}, description string, remote string, fully_remote boolean, is_new boolean"
CARDS = f"id string, ord long, title string, company string, locations array<string>, links {LINKS}, filter_status string, match_percent int, experience_rank int, experience_level string, role_group string, location_precheck string, is_new boolean, retained boolean"
STATE = "id string, status string, first_seen timestamp, last_seen timestamp, missed_runs int, active boolean, sources array<string>, transition string"
PENDING = "id string, payload string, attempts int, created_at timestamp, action string"
#: What a message about a card keeps of it.
MESSAGE = ("id", "title", "company", "locations", "links", "match_percent", "role_group", "experience_level", "location_precheck")


class Unusable(RuntimeError):
    """More than half of the sources gave nothing that can be used."""


def run(spark: SparkSession, path: str, sources: dict[str, Callable[[SparkSession], DataFrame]], profile: rules.Profile, now: Column, group_words=resolve.T.GROUP_WORDS) -> tuple[dict, DataFrame]:
    """Run all sources, each of which gives LISTINGS, against what the last run published at path; the new version and the
    sources' report.

    Cards, state and queue are parts of one commit, so readers see all of a run or nothing, and two runs at once can't
    both publish from one state. What a failed source would have shown stays as it was: its links are retained, and
    nothing of it counts as missed. A run with more failed sources than others stops before it publishes.
    """
    base = commits.version(spark, path)
    old = {part: commits.snapshot(spark, path, schema, base, [part]) for part, schema in (("cards", CARDS), ("state", STATE), ("pending", PENDING))}
    parts, report = union.fetch(spark, sources)
    if not union.usable(report).first()["usable"]:
        raise Unusable(str([tuple(r) for r in report.collect()]))
    failed = [r["name"] for r in report.where("status = 'failed'").collect()]
    names = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    # as the sources came: one order over all of them
    listings = union.scan_union(parts, ["id"], "ord") if parts else spark.createDataFrame([], LISTINGS).withColumn("source_ord", F.lit(0))
    known = old["state"].select("id", F.lit(False).alias("__new"))
    listings = listings.join(known, "id", "left").withColumn("is_new", F.coalesce("__new", F.lit(True))).withColumn("ord", F.col("source_ord") * F.lit(1 << 40) + F.col("ord"))
    merged = written(resolve.merge_duplicates(listings.select(*[c.split(" ")[0] for c in LISTINGS.split(", ")]), group_words), "run-merged")
    facts = merged.withColumns({"location": F.concat_ws("; ", "locations"), "employment": F.lit(""), "career_levels": names([]), "published_at": F.lit(None).cast("date"), "salary_min": F.lit(None).cast("int"), "salary_max": F.lit(None).cast("int")})
    scored = written(rules.score(facts, profile, F.to_date(now)).drop("reasons", "description"), "run-scored")  # scored once, then read
    new = scored.where("filter_status = 'included'").withColumnRenamed("sources", "links").withColumn("retained", F.lit(False))
    new = written(new.select(*[c for c in old["cards"].columns]), "run-cards")
    published = state.retain_skipped(old["cards"].drop("retained"), new.drop("retained"), failed).select(*old["cards"].columns)
    seen = merged.select("id", F.transform("sources", lambda s: s["source"]).alias("sources"))
    stepped = state.state_step(old["state"].drop("transition"), seen, now, names(sources), names([n for n in sources if n not in failed]))
    results = new.select("id", F.to_json(F.struct(*MESSAGE)).alias("payload"), F.lit(True).alias("notifiable"), "is_new")
    sent = spark.createDataFrame([], "id string")
    queue = state.queue_step(old["pending"].drop("action"), sent, results, now).select(F.col("id"), "payload", F.col("attempts").cast("int").alias("attempts"), F.col("created_at").cast("timestamp").alias("created_at"), "action")
    changed = {"cards": cards.retained_order(published), "state": stepped, "pending": queue}
    return commits.commit(spark, path, base, changed), report


def published(spark: SparkSession, path: str, part: str, at: dict | None = None) -> DataFrame:
    """cards, state or pending of a version, the newest by default."""
    return commits.snapshot(spark, path, {"cards": CARDS, "state": STATE, "pending": PENDING}[part], at, [part])
