"""Snapshots with a manifest, and restores that are checked row for row."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ops import same_rows


def digest_of(df: DataFrame) -> DataFrame:
    """(rows, digest): the digest does not depend on the rows' order, but on how often each occurs."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = df.select(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0)).cast("string").alias(f"p{k}") for k in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(",", "p0", "p1", "p2", "p3"), 256).alias("digest"))


def write(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write the tables and a manifest of their row counts and digests; nothing is written over."""
    for name in tables:
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"{name!r} names no table")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    rows = [(name, *spark.read.parquet(f"{path}/{name}").transform(digest_of).first()) for name in tables]
    manifest = spark.createDataFrame(rows, "name string, rows long, digest string")
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, each held against the manifest first."""
    out = {}
    for name, rows, digest in spark.read.parquet(f"{path}/manifest").collect():
        df = spark.read.parquet(f"{path}/{name}")
        if tuple(digest_of(df).first()) != (rows, digest):
            raise ValueError(f"table {name} is not what the manifest says")
        out[name] = df
    return out


def verify(before: DataFrame, after: DataFrame) -> bool:
    return same_rows(before.select(*sorted(before.columns)), after.select(*sorted(before.columns))).first()["same"]
