"""Persistent state over runs: discovery, change capture, publication with retained partitions, outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.resolve import sources_succeeded

MISSES = 3


def state_step(state: DataFrame, seen: DataFrame, now: Column, run_sources: Column, ok_sources: Column, misses: int = MISSES) -> DataFrame:
    """One run over state(id, status, first_seen, last_seen, missed_runs, active, sources) and seen(id, sources):
    the new state with transition (new, known, reactivated, missed, inactive, kept).

    Seen rows keep status and first_seen and lose their misses; unseen rows miss a run only if all of their sources
    that this run searched succeeded, and are inactive from `misses` on. One full outer join on the id.
    """
    s, n = state.alias("s"), seen.alias("n")
    j = s.join(n, F.col("s.id") == F.col("n.id"), "full_outer")
    here, there = F.col("n.id").isNotNull(), F.col("s.id").isNotNull()
    counts = ~here & F.col("s.active") & sources_succeeded(F.col("s.sources"), run_sources, ok_sources)
    missed = F.when(here, 0).when(counts, F.col("s.missed_runs") + 1).otherwise(F.col("s.missed_runs"))
    active = F.when(here, True).otherwise(F.col("s.active") & (missed < misses))
    transition = F.when(~there, "new").when(here & F.col("s.active"), "known").when(here, "reactivated").when(counts & (missed >= misses), "inactive").when(counts, "missed").otherwise("kept")
    return j.select(
        F.coalesce("s.id", "n.id").alias("id"),
        F.coalesce("s.status", F.lit("new")).alias("status"),
        F.coalesce("s.first_seen", now).alias("first_seen"),
        F.when(here, now).otherwise(F.col("s.last_seen")).alias("last_seen"),
        missed.cast("int").alias("missed_runs"),
        active.alias("active"),
        F.array_distinct(F.concat(F.coalesce("s.sources", F.array().cast("array<string>")), F.coalesce("n.sources", F.array().cast("array<string>")))).alias("sources"),
        transition.alias("transition"),
    )


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with change insert, update or delete; rows that are alike (nulls equal) do not appear."""
    values = [c for c in after.columns if c not in keys]
    b = before.select(*keys, F.struct(*values).alias("__b"))
    a = after.select(*keys, F.struct(*values).alias("__a"))
    j = b.join(a, keys, "full_outer")
    kind = F.when(F.col("__b").isNull(), "insert").when(F.col("__a").isNull(), "delete").when(~F.col("__a").eqNullSafe(F.col("__b")), "update")
    return j.select(*keys, kind.alias("change"), F.col("__a").alias("after"), F.col("__b").alias("before")).where("change is not null")


def apply_changes(before: DataFrame, diff: DataFrame, keys: list[str]) -> DataFrame:
    """before with the changes applied."""
    values = [c for c in before.columns if c not in keys]
    kept = before.join(diff.select(*keys), keys, "left_anti")
    new = diff.where("change <> 'delete'").select(*keys, *[F.col(f"after.{v}").alias(v) for v in values])
    return kept.select(*keys, *values).unionByName(new)


def retain_skipped(old: DataFrame, new: DataFrame, skipped: list[str], manual: str = "manual") -> DataFrame:
    """Publication of new(id, ord, links array<struct<source,url>>, ...) that keeps what this run did not search.

    An old row that is found again adds its links of skipped sources; one that is not found stays whole if it was
    entered by hand, else with the links of skipped sources if it has any; else it goes. Kept rows come after.
    """
    off = F.array(*[F.lit(s) for s in skipped]) if skipped else F.array().cast("array<string>")
    of_skipped = F.filter("links", lambda x: F.array_contains(off, x["source"]))
    o = old.withColumn("__by_hand", F.exists("links", lambda x: x["source"] == manual)).withColumn("__skipped", of_skipped)
    found = new.join(o.select("id", F.col("__skipped").alias("__more")), "id", "left")
    found = found.withColumn("links", F.when(F.col("__more").isNotNull(), F.array_union("links", "__more")).otherwise(F.col("links"))).drop("__more").withColumn("retained", F.lit(False))
    rest = o.join(new.select("id"), "id", "left_anti").where("__by_hand or size(__skipped) > 0")
    rest = rest.withColumn("links", F.when(F.col("__by_hand"), F.col("links")).otherwise(F.col("__skipped"))).drop("__by_hand", "__skipped").withColumn("retained", F.lit(True))
    return found.unionByName(rest)


def queue_step(pending: DataFrame, sent: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Outbox of pending(id, payload, attempts, created_at), sent(id) and this run's results(id, payload, notifiable,
    is_new): the next pending rows with action (kept, refreshed, queued).

    Results that are no longer notifiable leave the queue; new notifiable ones that were neither sent nor queued
    enter it; queued ones take the current payload; pending rows without a result this run stay.
    """
    p = pending.join(sent, "id", "left_anti").alias("p")
    r = results.alias("r")
    j = p.join(r, F.col("p.id") == F.col("r.id"), "full_outer").join(sent.select(F.col("id").alias("sent_id")), F.coalesce("p.id", "r.id") == F.col("sent_id"), "left")
    action = F.when(F.col("p.id").isNotNull() & F.col("r.id").isNull(), "kept").when(F.col("p.id").isNotNull() & F.col("r.notifiable"), "refreshed").when(F.col("p.id").isNull() & F.col("r.notifiable") & F.col("r.is_new") & F.col("sent_id").isNull(), "queued")
    return j.select(F.coalesce("p.id", "r.id").alias("id"), F.coalesce("r.payload", "p.payload").alias("payload"), F.coalesce("p.attempts", F.lit(0)).alias("attempts"), F.coalesce("p.created_at", now).alias("created_at"), action.alias("action")).where("action is not null")


def closure_candidates(state: DataFrame, seen: DataFrame, checks: DataFrame, now: Column, run_sources: Column, ok_sources: Column, limit: int = 200, recheck_hours: float = 24) -> DataFrame:
    """Urls of undecided rows (interesting, waiting) that the run did not see although it searched their sources,
    not checked within recheck_hours: the longest unchecked first, at most limit (a budget of the run)."""
    from millrace.functions.numbers import is_fresh

    absent = state.where(F.col("status").isin("interesting", "waiting")).join(seen.select("id"), "id", "left_anti").where(sources_succeeded(F.col("sources"), run_sources, ok_sources))
    urls = absent.select("id", F.explode("urls").alias("url")).join(checks, "url", "left")
    due = urls.where(~is_fresh(F.col("checked_at"), now, recheck_hours))
    return due.orderBy(F.col("checked_at").asc_nulls_first(), "url").limit(limit)


def close_confirmed(state: DataFrame, evidence: DataFrame, checks: DataFrame, now: Column, recheck_hours: float = 24) -> DataFrame:
    """Rows of state whose every url is freshly confirmed closed and whose status and urls are still those that the
    evidence was gathered for; a decision made meanwhile wins."""
    from millrace.functions.numbers import is_fresh

    e = evidence.select("id", F.col("status").alias("status_then"), F.col("urls").alias("urls_then"))
    j = state.join(e, "id").where(F.col("status").eqNullSafe(F.col("status_then")) & F.col("urls").eqNullSafe(F.col("urls_then")))
    closed = checks.where(is_fresh(F.col("checked_at"), now, recheck_hours) & F.col("closed"))
    hits = j.select("id", F.explode(F.array_distinct("urls")).alias("url"), F.size(F.array_distinct("urls")).alias("n")).join(closed, "url").groupBy("id", "n").agg(F.count("*").alias("hits"))
    return hits.where("hits = n").select("id")
