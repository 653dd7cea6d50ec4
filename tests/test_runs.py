"""Whole runs: what stops one, and what an empty one publishes."""

import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import rules, runs
from millrace.session import shared_base

PROFILE = rules.Profile(roles=[rules.Role("dev", "development", 30, [["developer"]])], local_places=["fulda"])


def broken(_):
    raise OSError("no route")


def test_runs_that_stop_publish_nothing(spark):
    path = f"{shared_base(spark)}/runs-{uuid.uuid4().hex}"
    now = F.lit("2024-01-01 06:00:00").cast("timestamp")
    one = [("a:1", 1, "Developer", "Acme", ["Fulda"], [("a", "u1")], "Wir bauen Software.", "", False, True), ("a:2", 2, "Gardener", "Acme", ["Fulda"], [("a", "u2")], "Draussen.", "", False, True)]
    with pytest.raises(runs.Unusable):
        runs.run(spark, path, {"a": broken, "b": broken, "c": lambda s: s.createDataFrame(one, runs.LISTINGS)}, PROFILE, now)
    assert runs.published(spark, path, "cards").count() == 0
    done, report = runs.run(spark, path, {"a": lambda s: s.createDataFrame(one, runs.LISTINGS), "b": broken}, PROFILE, now)
    assert done["version"] == 1 and {r["name"]: r["status"] for r in report.collect()} == {"a": "success", "b": "failed"}
    assert [r["id"] for r in runs.published(spark, path, "cards").collect()] == ["a:1"]  # the other has no role
    assert {r["id"]: r["transition"] for r in runs.published(spark, path, "state").collect()} == {"a:1": "new", "a:2": "new"}
    assert [r["action"] for r in runs.published(spark, path, "pending").collect()] == ["queued"]
