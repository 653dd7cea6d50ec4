"""An at-least-once outbox as streams: what is queued, what was acknowledged, and what has to be sent again.

Queued messages enter once within the watermark, however often they are queued. A message is joined with the
acknowledgements of its key that come within `patience` of its queueing; a left outer join of two streams with
watermarks gives those that got none as well, once the watermark says that none can come any more: these are due again.
State of both sides goes with the watermark.

Sending happens batch by batch. A batch that is tried again after a failure first looks at what its earlier try had put
on record, chunk by chunk, and sends the rest alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(queued: DataFrame, acknowledged: DataFrame, patience: str = "1 day", late: str = "1 hour") -> DataFrame:
    """queued(id, payload, queued_at) and acknowledged(id, acked_at), both streams, -> (id, payload, queued_at, acked_at,
    outcome): sent for each message with an acknowledgement from its queueing on until `patience` later (one row for each
    of them), retry for each without."""
    q = queued.withWatermark("queued_at", late).dropDuplicatesWithinWatermark(["id"])
    a = acknowledged.select(F.col("id").alias("ack_id"), "acked_at").withWatermark("acked_at", late)
    joined = q.join(a, F.expr(f"id = ack_id AND acked_at >= queued_at AND acked_at <= queued_at + INTERVAL {patience}"), "left_outer")
    return joined.select("id", "payload", "queued_at", "acked_at", F.when(F.col("ack_id").isNull(), "retry").otherwise("sent").alias("outcome"))


def deliver(stream: DataFrame, path: str, checkpoint: str, send: Callable[[list[str]], None], most_items: int = 10) -> None:
    """Send the rows of a stream (id, payload) over what is there, at most most_items at once, in the order of their ids within
    a batch; ids that are sent are on record in path/sent.

    A batch is written first, so that a second try finds the same rows. After each chunk its ids are recorded with a
    commit of their own; a failure between sending and recording sends that one chunk again (at least once), and no
    other. send runs on the driver, one chunk after another, as a receiver that limits its callers asks for.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = f"{path}/batches/{number}"
        try:
            rows = spark.read.schema(batch.schema).parquet(kept)
            spark.read.text(f"{kept}/_SUCCESS")
        except Exception:
            batch.write.mode("overwrite").parquet(kept)
            rows = spark.read.schema(batch.schema).parquet(kept)
        left = rows.join(on_record(spark, path), "id", "left_anti").orderBy("id").select("id", "payload")
        chunk: list = []

        def flush() -> None:
            if chunk:
                send([r["payload"] for r in chunk])
                spark.createDataFrame([(r["id"],) for r in chunk], left.select("id").schema).coalesce(1).write.mode("append").parquet(f"{path}/sent/chunk={uuid.uuid4().hex}")
                chunk.clear()

        for row in left.toLocalIterator():
            chunk.append(row)
            if len(chunk) == most_items:
                flush()
        flush()

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def on_record(spark, path: str) -> DataFrame:
    """(id) of what was sent."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/sent/*").select("id")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "id string")
