"""The outbox as streams: nothing is sent twice over tries, late acknowledgements count, the rest is due again."""

import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.session import shared_base
from millrace.streaming import events, outbox

QUEUED, ACKED = "id string, payload string, queued_at timestamp", "id string, acked_at timestamp"


@pytest.fixture
def path(spark):
    return f"{shared_base(spark)}/outbox-{uuid.uuid4().hex}"


def test_a_batch_tried_again_sends_the_rest_alone(spark, path):
    spark.range(25).select(F.format_string("m%02d", "id").alias("id"), F.concat(F.lit("p"), "id").alias("payload")).repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("id string, payload string").parquet(f"{path}/in")
    sent, calls = [], [0]

    def send(payloads):
        calls[0] += 1
        if calls[0] == 2:
            raise OSError("no route")
        sent.append(payloads)

    with pytest.raises(StreamingQueryException):
        outbox.deliver(stream, path, f"{path}/ckpt", send)
    assert [len(x) for x in sent] == [10]
    outbox.deliver(stream, path, f"{path}/ckpt", send)
    assert [len(x) for x in sent] == [10, 10, 5] and sorted(p for x in sent for p in x) == sorted(f"p{k}" for k in range(25))
    # more of the same ids in a later batch are not sent again
    spark.createDataFrame([("m01", "again"), ("m99", "new")], "id string, payload string").write.mode("append").parquet(f"{path}/in")
    outbox.deliver(stream, path, f"{path}/ckpt", send)
    assert sent[-1] == ["new"] and outbox.on_record(spark, path).count() == 26


def test_late_acknowledgements_count_and_the_rest_is_due_again(spark, path):
    def step(queued, acked):
        for name, rows, schema in (("q", queued, QUEUED), ("a", acked, ACKED)):
            spark.createDataFrame(rows, schema.replace("timestamp", "string")).select(*(F.col(c).cast("timestamp") if c.endswith("_at") else c for c in schema.replace(" string", "").replace(" timestamp", "").split(", "))).write.mode("append").parquet(f"{path}/{name}")
        streams = [spark.readStream.schema(s).parquet(f"{path}/{n}") for n, s in (("q", QUEUED), ("a", ACKED))]
        out = events.run_to_parquet(outbox.settled(*streams), f"{path}/out", f"{path}/ckpt")
        return sorted((r["id"], r["outcome"]) for r in out.collect())

    first = step([("in time", "x", "2024-01-01 00:00"), ("late", "x", "2024-01-01 00:10"), ("never", "x", "2024-01-01 00:20"), ("too late", "x", "2024-01-01 00:30"), ("never", "x", "2024-01-01 00:20")], [("in time", "2024-01-01 00:05")])
    assert first == [("in time", "sent")]
    # a batch later, with the watermark beyond its queueing, an acknowledgement within a day is still taken
    assert step([("other", "x", "2024-01-01 20:00"), ("in time", "x", "2024-01-01 00:00")], [("late", "2024-01-01 23:00")]) == [("in time", "sent"), ("late", "sent")]
    step([("z", "x", "2024-01-09 00:00")], [("too late", "2024-01-02 00:31"), ("z", "2024-01-09 00:00")])
    done = step([("zz", "x", "2024-01-19 00:00")], [("zz", "2024-01-19 00:00")])
    assert done == [("in time", "sent"), ("late", "sent"), ("never", "retry"), ("other", "retry"), ("too late", "retry"), ("z", "sent"), ("zz", "sent")]
