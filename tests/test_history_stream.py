"""Histories as keyed state: batches of commands give what one replay gives, and idle state goes."""

import datetime
import random
import uuid

import pytest

from millrace.operators import history
from millrace.session import shared_base
from millrace.streaming import events, histories

COMMANDS = "id string, seq long, kind string, status string, day string, place int, seen_status string, seen_day string"
STATE = "id string, status string, first_seen string, history array<struct<status:string,day:string>>"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", histories.ROCKSDB)
    yield f"{shared_base(spark)}/histories-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, path, batch, state=None, **options):
    spark.createDataFrame(batch, COMMANDS).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(COMMANDS).parquet(f"{path}/in")
    events.run_updates(histories.histories(stream, state, **options), f"{path}/out", f"{path}/ckpt")
    return spark.read.parquet(f"{path}/out/changes=*").collect()


def test_batches_are_one_replay(spark, rocksdb):
    r = random.Random(2)
    days = [None, "2024-01-01", "2024-02-01", "2024-03-01"]
    known = ["new", "ignored", "interesting", "applied", "odd"]
    commands = [(r.choice("abcdefg"), k, r.choice(["set"] * 4 + ["undo", "edit", "delete", "dance"]), r.choice(known), r.choice(days), r.choice([None, 0, 0, 1, 2]), r.choice(["new", "ignored", "interesting"]), r.choice(days)) for k in range(240)]
    state = spark.createDataFrame([("a", "new", "2023-12-01", []), ("b", "ignored", None, [("ignored", None)]), ("c", "interesting", "2023-12-02", None), ("z", "new", None, [])], STATE)
    want = {x["id"]: x for x in history.fold(state, spark.createDataFrame(commands, COMMANDS)).collect()}
    changed, refused = {}, {}
    seen = []
    for k in range(0, 240, 60):
        seen = run(spark, rocksdb, r.sample(commands[k : k + 60], 60), state)
    for x in sorted(seen, key=lambda x: x["changed_in"]):
        changed[x["id"]] = x
        refused.setdefault(x["id"], []).extend(x["refused"])
    assert set(changed) == set("abcdefg") and set(want) == {*changed, "z"}
    for k, x in changed.items():
        assert (x["status"], x["history"], refused[k]) == (want[k]["status"], want[k]["history"], want[k]["refused"])
    why = {y.split(": ")[1] for x in refused.values() for y in x}
    assert why >= {"changed meanwhile", "no such event", "unknown status", "unknown command"}


def test_idle_state_expires(spark, rocksdb):
    def step(*batch):
        rows = [(key, seq, "set", status, day, None, None, None, datetime.datetime.fromisoformat(day)) for key, seq, status, day in batch]
        schema = f"{COMMANDS}, at timestamp"
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{rocksdb}/in")
        events.run_updates(histories.histories(spark.readStream.schema(schema).parquet(f"{rocksdb}/in"), keep_days=30), f"{rocksdb}/out", f"{rocksdb}/ckpt")
        return [(x["id"], x["expired"], x["status"], [e["day"] for e in x["history"]]) for x in sorted(spark.read.parquet(f"{rocksdb}/out/changes=*").collect(), key=lambda x: (x["changed_in"], x["id"]))]

    step(("a", 1, "interesting", "2024-01-01"), ("b", 2, "ignored", "2024-01-01"))
    assert not any(x[1] for x in step(("b", 3, "interesting", "2024-01-25")))
    got = step(("c", 4, "ignored", "2024-02-05"))
    assert [x for x in got if x[1]] == [("a", True, "interesting", [None, "2024-01-01"])]
    # b was kept by its second command; a starts anew
    got = step(("a", 5, "ignored", "2024-02-06"), ("b", 6, "ignored", "2024-02-07"))
    assert ("a", False, "ignored", [None, "2024-02-06"]) in got and ("b", False, "ignored", [None, "2024-01-01", "2024-01-25", "2024-02-07"]) in got


def test_state_as_a_table_is_one_replay(spark):
    r = random.Random(4)
    path = f"{shared_base(spark)}/histories-{uuid.uuid4().hex}"
    days, known = [None, "2024-01-01", "2024-02-01", "2024-03-01"], ["new", "ignored", "interesting", "applied", "odd"]
    commands = [(r.choice([*"abcdefg", None]), k, r.choice(["set"] * 4 + ["undo", "edit", "delete", "dance"]), r.choice(known), r.choice(days), r.choice([None, 0, 0, 1, 2]), r.choice(["new", "ignored", "interesting"]), r.choice(days)) for k in range(320)]
    state = spark.createDataFrame([("a", "new", "2023-12-01", []), ("b", "ignored", None, [("ignored", None)]), ("c", "interesting", "2023-12-02", None), ("z", "new", None, [])], STATE)
    want = {x["id"]: x for x in history.fold(state, spark.createDataFrame(commands, COMMANDS)).collect()}
    for k in range(0, 320, 80):
        spark.createDataFrame(r.sample(commands[k : k + 80], 80), COMMANDS).write.mode("append").parquet(f"{path}/in")
        got = histories.run_histories(spark.readStream.schema(COMMANDS).parquet(f"{path}/in"), state, f"{path}/out", f"{path}/ckpt")
    got = {x["id"]: x for x in got.collect()}
    refused = {}
    for x in sorted(spark.read.parquet(f"{path}/out/changes=*").collect(), key=lambda x: x["changed_in"]):
        refused.setdefault(x["id"], []).extend(x["refused"])
    assert set(got) == set(want) == {*"abcdefgz", None} and got["a"]["first_seen"] == "2023-12-01"
    for k, x in got.items():
        assert (x["status"], x["history"], refused.get(k, [])) == (want[k]["status"], want[k]["history"], want[k]["refused"])
    # nothing new: the same state
    again = histories.run_histories(spark.readStream.schema(COMMANDS).parquet(f"{path}/in"), state, f"{path}/out", f"{path}/ckpt")
    assert {x["id"]: x for x in again.collect()} == got


def test_the_query_makes_no_calls_for_each_key(spark, monkeypatch):
    from millrace.plans import registry

    monkeypatch.setattr(histories, "_Histories", None)
    got, want = ({tuple(x) for x in registry.QUERIES[q](spark, "/root/testdata/sf0.001").collect()} for q in ("history_stream", "history_replay"))
    assert got == want and got
