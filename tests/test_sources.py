import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import archive, segments, structured, union


def test_segments_keep_what_they_gave_before_they_failed(spark, tmp_path):
    def page(seg, k, **body):
        (tmp_path / seg).mkdir(exist_ok=True)
        (tmp_path / seg / f"{k}.json").write_text(body["raw"] if "raw" in body else json.dumps(body))

    page("a", 0, records=[{"id": 1}, {"id": 2}], total=3)
    page("a", 1, records=[{"id": 3}], total=3)
    page("a", 2, records=[{"id": 99}])  # behind the total
    page("b", 0, records=[{"id": 4}])
    page("b", 1, raw="{broken")
    page("c", 0, records=[])
    page("d", 0, records=[{"id": 5, "title": None}], next=False)
    rows, report = segments.read_segments(spark, str(tmp_path))
    assert sorted(json.loads(r["payload"])["id"] for r in rows.collect()) == [1, 2, 3, 4, 5]
    assert tuple(report.first()) == (5, 1, 4)
    assert report.select(union.coverage_status()).first()[0] == "partial"
    good, bad = segments.convert(rows.withColumn("payload", F.when(F.col("segment") == "b", F.lit("{")).otherwise(F.col("payload"))), "payload", "id int, title string", ["id"])
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 3, 5] and bad.count() == 1


def test_a_failing_source_stops_no_other(spark):
    def broken(_):
        raise OSError("no route")

    parts, report = union.fetch(spark, {"a": lambda s: s.range(3), "b": broken, "c": lambda s: s.range(0)})
    assert {r["name"]: r["status"] for r in report.collect()} == {"a": "success", "b": "failed", "c": "empty"} and set(parts) == {"a", "c"}
    assert union.usable(report).first()["usable"]
    assert not union.usable(report.where("name = 'b'")).first()["usable"] and not union.usable(report.limit(0)).first()["usable"]
    half = spark.createDataFrame([("a", "failed", 0), ("b", "success", 1)], "name string, status string, rows long")
    assert union.usable(half).first()["usable"]  # exactly half may be lost


def test_first_source_wins(spark):
    a = spark.createDataFrame([("u", 1, "x")], "url string, ord int, a string")
    b = spark.createDataFrame([("u", 0, "y"), ("v", 1, "y")], "url string, ord int, b string")
    got = {r["url"]: (r["source_name"], r["a"], r["b"]) for r in union.scan_union({"a": a, "b": b}, ["url"], "ord").collect()}
    assert got == {"u": ("a", "x", None), "v": ("b", None, "y")}


def test_frontier_stops_after_two_old_pages(spark):
    df = spark.createDataFrame([(i, o) for i, o in enumerate([0, 1, 0, 1, 1, 0])], "page int, old int")
    assert [r["page"] for r in union.date_frontier(df, "page", F.col("old") == 1).orderBy("page").collect()] == [0, 1, 2, 3, 4]


POSTING = {"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Fulda"}}, {"address": {"addressLocality": "Fulda"}}], "description": "<p>Do &amp; learn</p>", "employmentType": ["FULL_TIME", ""], "datePosted": "2024-01-02T03:00", "identifier": {"value": 7}, "baseSalary": {"currency": "EUR", "value": {"minValue": 50000, "maxValue": "60000", "unitText": "YEAR"}}}


@pytest.mark.parametrize("wrap", [lambda p: p, lambda p: [{"@type": "Thing"}, p], lambda p: {"@graph": [{"x": {"y": p}}]}])
def test_postings_anywhere_in_json_ld(spark, wrap):
    script = '<script async type="application/ld+json">%s</script>'
    page = "<html>" + script % "{broken" + script % json.dumps(wrap(POSTING)) + "</html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>none</p>"), (4, script % json.dumps(wrap(POSTING)).replace('"', "&quot;"))], "page_id long, html string")
    got = {r["page_id"]: r for r in structured.postings(df, "page_id", "html").collect()}
    assert set(got) == {1, 4}
    r = got[1]
    assert (r["title"], r["company"], r["locations"], r["description"], r["employment"], r["published"], r["identifier"], r["salary_min"], r["salary_max"]) == ("Dev", "Acme", ["Fulda"], "Do & learn", "FULL_TIME", "2024-01-02", "7", 50000, 60000)


def test_other_currencies_and_periods_give_no_salary():
    pay = lambda **kw: structured.yearly_salary({"baseSalary": {"currency": "EUR", "value": {"value": 9, "unitText": "YEAR"}} | kw})
    assert pay() == (9, 9) and pay(currency="USD") == (None, None) and pay(value={"value": 9, "unitText": "MONTH"}) == (None, None)
    assert structured.yearly_salary({}) == (None, None)


def test_script_json_and_feeds(spark):
    df = spark.createDataFrame([('<script id="st" type="x">{"a": [1, 2]}</script>',), ("<p>",)], "html string")
    got = df.select(F.try_variant_get(structured.script_json(F.col("html"), "st"), "$.a[1]", "int").alias("x")).collect()
    assert [r["x"] for r in got] == [2, None]
    xml = "<jobs><job><id>1</id><title><![CDATA[A & B]]></title></job><job><id>x</id></job></jobs>"
    items = structured.feed_items(spark.createDataFrame([("f", xml)], "feed string, xml string"), "xml", "job", "id int, title string").collect()
    assert (items[0]["id"], items[0]["title"]) == (1, "A & B") and items[1]["id"] is None


def test_archive_refuses_a_second_write(spark, tmp_path):
    rows = spark.createDataFrame([("j", "t")], "id string, title string")
    at = F.lit("2024-02-03 04:05:06").cast("timestamp")
    archive.write_snapshot(rows, f"{tmp_path}/a", at, "r1")
    with pytest.raises(ValueError):
        archive.write_snapshot(rows, f"{tmp_path}/a", at, "r1")
    archive.write_snapshot(rows, f"{tmp_path}/a", at, "r2")
    back = archive.read_archive(spark, f"{tmp_path}/a")
    assert back.count() == 2 and {(r["year"], r["month"], r["day"]) for r in back.collect()} == {(2024, 2, 3)}
    assert list((tmp_path / "a").rglob("*.json.gz"))


def test_cache_ages(spark):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    links = spark.createDataFrame([(u,) for u in "abcdef"], "url string")
    cache = spark.createDataFrame([("a", "c", 6), ("b", "c", 7), ("c", "c", 13), ("d", "c", 14), ("e", "c", 8)], "url string, payload string, age int").withColumn("stored_at", now - F.make_dt_interval("age")).drop("age")
    fetched = spark.createDataFrame([("b", "f", True, False), ("e", None, False, True), ("f", "f", True, False)], "url string, payload string, ok boolean, unavailable boolean")
    got = {r["url"]: (r["origin"], r["cache_stale"]) for r in union.with_cache(links, cache, fetched, now).collect()}
    assert got == {"a": ("cache", False), "b": ("fetched", False), "c": ("stale", True), "f": ("fetched", False)}
