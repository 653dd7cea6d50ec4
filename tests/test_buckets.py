"""Merges into buckets: only touched parts are rewritten, and the state isn't shuffled."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import buckets
from millrace.session import shared_base

SCHEMA = "id long, v string, n int"


@pytest.fixture
def table(spark):
    name = f"t{uuid.uuid4().hex}"
    t = buckets.Bucketed(name, f"{shared_base(spark)}/{name}", "id", parts=4, buckets=8)
    t.create(spark.range(200).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("v"), "id")).alias("v"), F.col("id").cast("int").alias("n")))
    yield t
    spark.sql(f"DROP TABLE {name}")


def files(table):
    top = table.path.removeprefix("file://").removeprefix("file:")
    return {p: {f for f in os.listdir(f"{top}/{p}") if f.startswith("part-")} for p in os.listdir(top) if p.startswith("part=")}


def rows(spark, table):
    return {r["id"]: (r["v"], r["n"]) for r in table.rows(spark).collect()}


def test_only_touched_parts_change(spark, table):
    before, old = files(table), rows(spark, table)
    part = {r["id"]: r["p"] for r in spark.range(1000).select("id", F.pmod(F.hash("id"), F.lit(4)).alias("p")).collect()}
    here = [k for k in range(200) if part[k] == 1]
    other = next(k for k in range(200) if part[k] == 2)
    new = next(k for k in range(200, 1000) if part[k] == 1)
    # an update, a deletion, a new row, and changes that change nothing (nulls as well), one of them in another part
    same = next(k for k in here if k % 3 == 0)
    up, gone = [k for k in here if k % 3][:2]
    changes = [(up, "w", None, False), (gone, None, None, True), (new, None, 5, False), (same, None, same, False), (other, *old[other], False), (999_999, None, None, True)]
    assert buckets.merge(table, spark.createDataFrame(changes, "id long, v string, n int, delete boolean")) == [1]
    assert rows(spark, table) == {k: v for k, v in old.items() if k != gone} | {up: ("w", None), new: (None, 5)}
    after = files(table)
    assert {p for p in after if after[p] != before[p]} == {"part=1"}
    assert buckets.merge(table, spark.createDataFrame([(up, "w", None, None)], "id long, v string, n int, delete boolean")) == [] and files(table) == after
    # a part whose rows all go
    assert buckets.merge(table, spark.createDataFrame([(k, None, None, True) for k in rows(spark, table) if part[k] == 3], "id long, v string, n int, delete boolean")) == [3]
    assert all(part[k] != 3 for k in rows(spark, table)) and len(rows(spark, table)) > 100


def test_the_state_is_not_shuffled(spark, table):
    changes = spark.createDataFrame([(1, "x", 1, False)], "id long, v string, n int, delete boolean")
    plan = buckets.joined(table, changes, [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(id" in plan and "REPARTITION_BY" in plan  # that of the changes
    assert "Bucketed: true" in plan


def test_changes_must_be_one_a_key(spark, table):
    for bad in ([(1, "x", 1, False), (1, "y", 1, False)], [(None, "x", 1, False)]):
        with pytest.raises(ValueError):
            buckets.merge(table, spark.createDataFrame(bad, "id long, v string, n int, delete boolean"))
    assert buckets.merge(table, spark.createDataFrame([], "id long, v string, n int, delete boolean")) == []
