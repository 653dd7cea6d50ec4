"""Sessions and keyed state over batches of files that are not in the order of time."""

import uuid

from pyspark.sql import functions as F

from millrace.session import shared_base
from millrace.streaming import events

SCHEMA = "event_id long, user_id long, ts timestamp, failed boolean"


def batch(spark, path, *rows):
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, failed boolean").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"{path}/in")


def test_sessions_stay_off_the_driver_and_take_files_in_any_order(spark):
    path = f"{shared_base(spark)}/sessions-{uuid.uuid4().hex}"
    for rows in (((1, 1, "2024-02-01 08:00:00", False), (2, 2, "2024-02-01 08:00:00", False)), ((3, 1, "2024-01-01 08:00:00", False), (4, 2, "2024-02-01 03:00:00", False)), ()):
        stream = batch(spark, path, *rows) if rows else spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        out = events.run_complete(events.sessions(stream, "ts", "user_id", "6 hours", "3650 days"), f"{path}/out", f"{path}/ckpt")
    got = out.select("user_id", F.date_format("start", "MM-dd HH").alias("s"), "n").collect()
    assert sorted(map(tuple, got)) == [(1, "01-01 08", 1), (1, "02-01 08", 1), (2, "02-01 03", 2)]
    assert "LocalRelation" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tracked_rows_are_taken_by_time_and_only_used_columns_go_to_python(spark):
    path = f"{shared_base(spark)}/track-{uuid.uuid4().hex}"
    stream = batch(spark, path, (1, 7, "2024-01-03 00:00:00", True), (3, 7, "2024-01-02 00:00:00", True), (2, 7, "2024-01-02 00:00:00", False), (4, 7, "2024-01-04 00:00:00", True)).withColumn("props", F.lit("x"))
    tracked = events.track(stream, "user_id", "failed")
    assert "props" not in tracked._jdf.queryExecution().analyzed().toString().split("Project")[0] and [c for c in tracked.columns] == ["user_id", "seen", "errors", "streak", "active"]
    out = events.run_upserts(tracked, ["user_id"], f"{path}/out", f"{path}/ckpt")
    assert [tuple(r) for r in out.collect()] == [(7, 4, 3, 3, False)]
