"""Scans over several sources: union in source order, isolation of failures, coverage reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.resolve import first_wins
from millrace.session import written

REPORT = "name string, status string, rows long, failed_segments int, total_segments int, error string"


def scan_union(parts: dict[str, DataFrame], keys: list[str], order: str) -> DataFrame:
    """Rows of all sources with source_name and source_ord; of rows with one key the first source's first row stays."""
    named = [df.withColumn("source_name", F.lit(n)).withColumn("source_ord", F.lit(k)) for k, (n, df) in enumerate(parts.items())]
    return first_wins(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named), keys, ["source_ord", order])


def fetch(spark: SparkSession, sources: dict[str, Callable[[SparkSession], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The sources that can be read, and a report for each. A source that fails, in planning or while it is read, becomes
    a failed report and never stops the others. Each is read once, into a table in the shared folder."""
    parts, reports = {}, []
    for name, make in sources.items():
        try:
            df = written(make(spark), "fetched")
            n = df.count()
        except Exception as error:  # whatever a source raises is that source's failure
            reports.append((name, "failed", 0, None, None, type(error).__name__))
            continue
        parts[name] = df
        reports.append((name, "success" if n else "empty", n, 0, 1, None))
    return parts, spark.createDataFrame(reports, REPORT)


def coverage_status(failed: str = "failed_segments", total: str = "total_segments", rows: str = "rows"):
    """failed where all segments failed and nothing came, partial where some did, else success or empty."""
    f, t, n = F.col(failed), F.col(total), F.col(rows)
    return F.when((f == t) & (t > 0) & (n == 0), "failed").when(f > 0, "partial").when(n > 0, "success").otherwise("empty")


def usable(reports: DataFrame) -> DataFrame:
    """One row: sources, unusable ones (failed, or partial without rows), and whether the run may go on: there are reports
    and not more than half is unusable."""
    bad = (F.col("status") == "failed") | ((F.col("status") == "partial") & (F.col("rows") == 0))
    return reports.agg(F.count("*").alias("sources"), F.count_if(bad).alias("unusable")).withColumn("usable", (F.col("sources") > 0) & (F.col("unusable") * 2 <= F.col("sources")))


def with_cache(links: DataFrame, cache: DataFrame, fetched: DataFrame, now, fresh_days: int = 7, stale_days: int = 14) -> DataFrame:
    """links(url) with payload and origin: the cached payload if younger than fresh_days, else what was fetched, else a
    cached one younger than stale_days (cache_stale); links with none of them go, and so do unavailable ones.
    cache(url, payload, stored_at); fetched(url, payload, ok, unavailable)."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("stored_at"))) / 8.64e10
    j = links.join(cache.withColumnRenamed("payload", "cached"), "url", "left").join(fetched, "url", "left").withColumn("age", age)
    origin = F.when((F.col("age") >= 0) & (F.col("age") < fresh_days), "cache").when(F.coalesce("unavailable", F.lit(False)), "gone").when(F.coalesce("ok", F.lit(False)), "fetched").when((F.col("age") >= 0) & (F.col("age") < stale_days), "stale").otherwise("failed")
    out = j.withColumn("origin", origin).where(F.col("origin").isin("cache", "fetched", "stale"))
    return out.select("url", F.when(F.col("origin") == "fetched", F.col("payload")).otherwise(F.col("cached")).alias("payload"), "origin", (F.col("origin") == "stale").alias("cache_stale"))


def date_frontier(pages: DataFrame, order: str, is_old, stop_after: int = 2, by: tuple = ()) -> DataFrame:
    """Pages of each listing up to the point where stop_after old ones follow one another (that run of pages included).
    by: the columns that tell listings apart (source, segment); without any, the pages are one listing."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    run = F.sum(F.when(is_old, 1).otherwise(0)).over(w.rowsBetween(-(stop_after - 1), 0))
    stops = pages.withColumn("__stop", (run >= stop_after).cast("int"))
    before = F.coalesce(F.sum("__stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stops.withColumn("__b", before).where("__b = 0").drop("__b", "__stop")
