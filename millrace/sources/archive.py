"""Listing archive: gzip JSON Lines in folders by year, month and day; nothing is written over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(listings: DataFrame, path: str, seen_at: Column, run_id: str) -> None:
    """Append a run's listings. A run that was archived before is refused."""
    spark = listings.sparkSession
    try:
        old = read_archive(spark, path).where(F.col("run_id") == run_id).limit(1).count()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        old = 0
    if old:
        raise ValueError(f"run {run_id} is in the archive already")
    rows = listings.withColumn("run_id", F.lit(run_id)).withColumn("seen_at", seen_at)
    rows = rows.withColumns({"year": F.date_format("seen_at", "yyyy"), "month": F.date_format("seen_at", "MM"), "day": F.date_format("seen_at", "dd")})
    rows.write.mode("append").option("compression", "gzip").partitionBy("year", "month", "day").json(path)


def read_archive(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def prune(cache: DataFrame, stored_at: str, now: Column, days: int = 14) -> DataFrame:
    """Rows younger than days (14 at least)."""
    if days < 14:
        raise ValueError("a cache is kept for 14 days at least")
    return cache.where(F.col(stored_at) >= now - F.make_dt_interval(F.lit(days)))


def newest(backups: DataFrame, name: str, n: int) -> DataFrame:
    """The n newest by name; there are few."""
    return backups.orderBy(F.desc(name)).limit(n)
