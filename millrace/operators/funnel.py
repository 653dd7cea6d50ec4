"""Histories of dated events per entity: current status, first and next dates, gaps, funnel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_RESPONSE_DAYS = 14


def ordered_history(events: DataFrame, key: str, status: str, day: str, place: str) -> DataFrame:
    """(key, history array<struct<day,place,status>>): by date, unknown dates first, then by place."""
    item = F.struct(F.col(day).isNotNull().alias("dated"), F.col(day).alias("day"), F.col(place).alias("place"), F.col(status).alias("status"))
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("h"))
    return rows.select(key, F.transform("h", lambda x: F.struct(x["day"].alias("day"), x["place"].alias("place"), x["status"].alias("status"))).alias("history"))


def current_status(history: Column) -> Column:
    return F.element_at(history, -1)["status"]


def first_day(history: Column, statuses: list[str], not_before: Column | None = None) -> Column:
    """First date of one of the statuses, not before a date if one is given."""
    ok = lambda e: e["status"].isin(*statuses) & e["day"].isNotNull() & (F.lit(True) if not_before is None else e["day"] >= not_before)
    return F.array_min(F.transform(F.filter(history, ok), lambda e: e["day"]))


def applications(events: DataFrame, key: str, status: str, day: str, place: str, as_of: Column, applied: str, responses: list[str], closed: list[str], gap: int = NO_RESPONSE_DAYS) -> DataFrame:
    """A row for each entity: applied_on, responded_on (first response on or after it), response_days, current status,
    waiting_since, no_response (waited gap days or more) and completed."""
    h = ordered_history(events, key, status, day, place)
    h = h.withColumn("applied_on", first_day(F.col("history"), [applied])).withColumn("status", current_status(F.col("history")))
    h = h.withColumn("responded_on", first_day(F.col("history"), responses, F.col("applied_on")))
    last = F.array_max(F.transform("history", lambda e: e["day"]))
    waiting = F.when((F.col("status") == applied) & F.col("responded_on").isNull(), F.col("applied_on")).when(F.col("status").isin(*responses) & ~F.col("status").isin(*closed), last)
    h = h.withColumn("waiting_since", waiting).withColumn("response_days", F.date_diff("responded_on", "applied_on"))
    h = h.withColumn("no_response", F.coalesce(F.date_diff(as_of, F.col("waiting_since")) >= gap, F.lit(False)))
    return h.withColumn("completed", F.col("status").isin(*closed) | F.col("no_response")).drop("history")


def statistics(rows: DataFrame) -> DataFrame:
    """One row: total, open, completed, responded, no_response, response rate over the completed (whole percent, half
    to even), mean response days (one decimal) and how many it rests on."""
    responded = F.col("responded_on").isNotNull()
    a = rows.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("completed")).alias("open"),
        F.count_if("completed").alias("completed"),
        F.count_if(responded).alias("responded"),
        F.count_if("no_response").alias("no_response"),
        F.count_if(responded & F.col("completed")).alias("_rc"),
        F.bround(F.avg("response_days"), 1).alias("mean_response_days"),
        F.count("response_days").alias("response_samples"),
    )
    rate = F.when(F.col("completed") == 0, 0.0).otherwise(F.bround(F.lit(100.0) * F.col("_rc") / F.col("completed"), 0))
    return a.select("total", "open", "completed", "responded", "no_response", rate.alias("response_rate"), "mean_response_days", "response_samples")


def stage_shares(stats: DataFrame, stages: list[str], total: str = "total") -> DataFrame:
    """(stage, n, share of total in whole percent) for each column named."""
    item = lambda s: F.struct(F.lit(s).alias("stage"), F.col(s).cast("long").alias("n"))
    rows = stats.select(F.col(total).alias("_t"), F.explode(F.array(*[item(s) for s in stages])).alias("x"))
    return rows.select("x.stage", "x.n", F.when(F.col("_t") == 0, 0.0).otherwise(F.bround(F.lit(100.0) * F.col("x.n") / F.col("_t"), 0)).alias("share"))


def neighbours(events: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """(key, next_at, last_at): first event at or after now, last one before."""
    return events.groupBy(key).agg(F.min(F.when(F.col(at) >= now, F.col(at))).alias("next_at"), F.max(F.when(F.col(at) < now, F.col(at))).alias("last_at"))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
