"""Structured Streaming over event files: windows with watermarks, idempotent queueing, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.commits import file_system


def read_events(spark: SparkSession, path: str, schema, at: str = "ts", files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files; the event time is cast to a timestamp with zone, as watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def windowed(stream: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window(at, length, slide) if slide else F.window(at, length)
    out = stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, at: str, key: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: queueing that may be tried again."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


STATE = "seen long, errors long, streak long, active boolean"


def track(stream: DataFrame, key: str, failed: str, misses: int = 3, at: str = "ts", late: str = "1 day", keep_days: int = 3650) -> DataFrame:
    """Keyed state over micro-batches: how often a key was seen and failed, its current run of failures, and whether it is
    active (fewer than `misses` failures in a row). Rows within a batch are taken by event time. The state of a key that
    the watermark has left behind by keep_days is dropped."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, errors, streak, _ = state.get if state.exists else (0, 0, 0, True)
        found = list(frames)
        times, ids, bads = (np.concatenate([f[c].to_numpy() for f in found]) for c in (at, "event_id", failed))
        order = np.lexsort((ids, times))
        for bad in bads[order].tolist():
            seen, errors, streak = seen + 1, errors + bad, streak + 1 if bad else 0
        state.update((seen, int(errors), int(streak), bool(streak < misses)))
        last = max(int(pd.Timestamp(times[order[-1]]).timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(last + keep_days * 86_400_000)
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "errors": [int(errors)], "streak": [int(streak)], "active": [bool(streak < misses)]})

    used = stream.select(key, at, "event_id", failed)  # nothing else goes to Python
    return used.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, f"{key} long, {STATE}", STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run over what is there in update mode; the rows that batch n changed are in path/changes=n, with changed_in n."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("changed_in", F.lit(number)).write.mode("overwrite").parquet(f"{path}/changes={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()


def run_upserts(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run over what is there in update mode: each batch writes the rows that it changed into a folder of its own, anew if
    it is tried again, so nothing gathers on the driver and state behind the watermark goes. The result is the latest
    row of each key."""

    run_updates(stream, path, checkpoint)
    rows = stream.sparkSession.read.parquet(f"{path}/changes=*")
    others = [c for c in rows.columns if c not in (*keys, "changed_in")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "changed_in").alias("x")).select(*keys, "x.*")


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over what is there in complete mode, as sessions need it, which have no update mode. Each batch writes the whole
    result into a folder of its own, anew if it is tried again, and the one before goes, so nothing gathers on the
    driver. The result is the newest folder."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        for old in _batches(spark, path):
            if old < number:
                fs, at = file_system(spark, f"{path}/batch-{old}")
                fs.delete(at, True)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    there = _batches(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch-{there[-1]}") if there else spark.createDataFrame([], stream.schema)


def _batches(spark: SparkSession, path: str) -> list[int]:
    fs, at = file_system(spark, path)
    return sorted(int(x.getPath().getName().removeprefix("batch-")) for x in fs.listStatus(at)) if fs.exists(at) else []


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over what is there in append mode; the file sink commits each batch once."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
