import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import listing as L
from millrace.operators import evals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_links_and_labels(spark):
    src = "array<struct<url:string,application_url:string>>"
    f = lambda x: one(spark, L.primary_url(F.from_json(F.lit(json.dumps(x)), src)))
    assert f([{"url": "a"}, {"url": "b", "application_url": "c"}]) == "c" and f([{"url": "a", "application_url": ""}]) == "a" and f([]) == ""
    assert one(spark, L.display_remote(F.lit(60), F.lit("hybrid"))) == "60%" and one(spark, L.display_remote(F.lit(None).cast("int"), F.lit("remote"))) == "100%"
    assert one(spark, L.role_label(F.lit("a_b"), {})) == "a b" and one(spark, L.role_label(F.lit("a"), {"a": "A!"})) == "A!"
    assert one(spark, L.route_destination(F.array(F.lit("Deutschland, Remote"), F.lit("Fulda, Hessen")), ("deutschland", "remote"))) == "Fulda"
    assert one(spark, L.place_text(F.array(F.lit("")))) == "unknown"
    assert one(spark, L.urls_in(F.lit("see https://a.de/x. and (https://a.de/x), http://b"))) == ["https://a.de/x", "http://b"]
    assert one(spark, L.verified(F.array(F.lit("https://a/"), F.lit("https://b")), F.array(F.lit("https://a.")))) == ["https://a/"]


def test_times(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    now = at("2024-03-01 12:00:00")
    assert one(spark, L.run_label(at("2024-02-29 23:30:00"), now)) == "today 00:30"
    assert one(spark, L.run_label(at("2024-02-29 22:30:00"), now)) == "yesterday 23:30"
    assert one(spark, L.run_label(at("2024-02-01 22:30:00"), now)) == "01.02.2024"
    assert one(spark, L.local_date(at("2024-06-30 22:00:00"))) == dt.date(2024, 7, 1)
    assert one(spark, L.appointment_time(F.lit("interview"), F.lit("2024-01-02T03:04"))) == dt.datetime(2024, 1, 2, 3, 4)
    assert one(spark, L.appointment_time(F.lit("applied"), F.lit("2024-01-02T03:04"))) is None
    assert [one(spark, L.retry_after(F.lit(v))) for v in ("1", "30", "99", "x")] == [5, 30, 65, 5]


def test_usage_and_money(spark):
    u = lambda x: tuple(one(spark, L.usage_of(F.lit(x), F.lit(2))))
    assert u('{"usage": {"input_tokens": 5, "input_tokens_details": {"cached_tokens": 3}}}') == (5, 3, 0, 2) and u("no") == (0, 0, 0, 2)
    assert one(spark, L.money_in(F.lit("50.000 euro"))) and not one(spark, L.money_in(F.lit("50 leute")))
    assert one(spark, L.safe_attributes(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), ("a",))) == {"a": "1"}


GOOD = {"lines": {"pay": {"light": "gruen", "text": "ok"}}, "extras": [{"topic": str(i), "light": "gelb", "text": "t"} for i in range(4)], "verdict": {"level": "bewerben", "text": "yes"}, "sources": ["u", "u"]}


@pytest.mark.parametrize(
    "change,error",
    [({}, None), ({"lines": {}}, "line missing"), ({"lines": GOOD["lines"] | {"x": {"light": "rot", "text": "t"}}}, "unknown line"), ({"lines": {"pay": {"light": "blau", "text": "t"}}}, "unknown light"), ({"lines": {"pay": {"light": "rot", "text": " "}}}, "text missing"), ({"verdict": {"level": "hm", "text": "t"}}, "unknown verdict"), ({"verdict": None}, "not a sheet")],
)
def test_fact_sheets(spark, change, error):
    r = one(spark, L.fact_sheet(F.lit(json.dumps(GOOD | change)), ["pay"]))
    assert r["error"] == error and (r["sheet"] is None) == (error is not None)
    if error is None:
        assert len(r["sheet"]["extras"]) == 2 and r["sheet"]["sources"] == ["u"]


def test_broken_sheet(spark):
    assert one(spark, L.fact_sheet(F.lit("{"), ["pay"]))["error"] == "not a sheet"


def test_reports(spark):
    df = spark.createDataFrame([("c", "a", 2, "x"), ("c", "a", 1, None)], "case string, variant string, round int, verdict string")
    assert evals.marks(df, "case", "variant", "round", "verdict").first()["marks"] == "–, x"
    s = evals.summarize(spark.createDataFrame([("a", True, 0.1, 2.0), ("a", None, 0.2, 4.0)], "variant string, ok boolean, cost double, seconds double"), "variant", "ok", "cost", "seconds")
    assert "| a | 1/2 (50 %) | 0.300 | 3.0 |" in evals.report(s, "variant")
