import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import pages as P
from millrace.operators import backup, history, identity, publish

NOW = dt.date(2024, 3, 1)
L = "id string, title string, company string, urls array<string>, locations array<string>, fully_remote boolean, published_on date"
E = L.replace("published_on date", "status string, decided boolean, applied boolean, completed boolean, active boolean, first_seen string, dated_on date")


def entry(i, title="Dev", company="Acme", urls=(), places=("Fulda",), status="new", decided=False, applied=False, completed=False, active=True, seen="2024-01-01", dated=None):
    return (i, title, company, list(urls), list(places), False, status, decided or applied, applied, completed, active, seen, dated)


def resolved(spark, listing, entries, aliases=()):
    df = spark.createDataFrame([listing], L)
    r = identity.resolve(df, spark.createDataFrame(list(entries), E), spark.createDataFrame(list(aliases), "alias string, id string"), F.lit(NOW)).first()
    return r["canonical_id"], r["folded"]


def listing(i="l", title="Dev (m/w/d)", company="ACME GmbH", urls=("u",), places=("Fulda",), published=None):
    return (i, title, company, list(urls), list(places), False, published)


def test_own_entries_by_id_alias_and_url(spark):
    assert resolved(spark, listing(), []) == ("l", [])
    assert resolved(spark, listing(title="x"), [entry("l", seen="2024-02-01"), entry("e", urls=["u"])]) == ("e", ["l"])
    assert resolved(spark, listing(title="x"), [entry("a")], [("l", "a")]) == ("a", [])


def test_title_matches_are_guarded_by_decisions(spark):
    assert resolved(spark, listing(), [entry("e", places=["Ulm"])])[0] == "e"  # undecided: any place
    assert resolved(spark, listing(), [entry("e", places=["Ulm"], decided=True)])[0] == "l"  # decided elsewhere
    assert resolved(spark, listing(), [entry("e", places=["36037 Fulda", "Ulm"], decided=True)])[0] == "e"
    assert resolved(spark, listing(), [entry("e", active=False)])[0] == "l"
    assert resolved(spark, listing(), [entry("e", active=False, status="ignored", decided=True)])[0] == "e"
    # an own decided entry takes no titles
    assert resolved(spark, listing(), [entry("own", urls=["u"], decided=True), entry("t")]) == ("own", [])


def test_completed_applications_only_within_thirty_days(spark):
    done = lambda day: [entry("e", status="rejected", applied=True, completed=True, dated=day)]
    assert resolved(spark, listing(published=dt.date(2024, 2, 1)), done(dt.date(2024, 1, 2)))[0] == "e"
    assert resolved(spark, listing(published=dt.date(2024, 2, 2)), done(dt.date(2024, 1, 2)))[0] == "l"
    assert resolved(spark, listing(), done(None))[0] == "l"


def test_listing_without_company_joins_applications_only(spark):
    assert resolved(spark, listing(company=""), [entry("e")])[0] == "l"
    assert resolved(spark, listing(company=""), [entry("e", status="applied", applied=True)])[0] == "e"
    assert resolved(spark, listing(company="", places=["Fulda", "Bonn"]), [entry("e", status="applied", applied=True)])[0] == "l"


def test_canonical_and_folding(spark):
    es = [entry("new", seen="2023-01-01"), entry("dec", decided=True, seen="2024-02-01"), entry("app", applied=True, status="applied", seen="2024-02-02"), entry("far", places=["Ulm"])]
    assert resolved(spark, listing(), es) == ("app", ["new"])  # decided ones stay, and so does what the decision was not made for


S = "id string, status string, first_seen string, history array<struct<status:string,day:string>>"
C = "id string, seq int, kind string, status string, day string, place int, seen_status string, seen_day string"


def folded(spark, commands, state=(("a", "new", "2024-01-01", []),)):
    rows = [("a", i, *c) for i, c in enumerate(commands)]
    r = next(x for x in history.fold(spark.createDataFrame(list(state), S), spark.createDataFrame(rows, C)).collect() if x["id"] == "a")
    return r["status"], [tuple(e) for e in r["history"]], r["refused"]


def test_first_change_records_where_it_came_from(spark):
    assert folded(spark, [("set", "interesting", "2024-01-05", None, None, None)]) == ("interesting", [("new", "2024-01-01"), ("interesting", "2024-01-05")], [])
    assert folded(spark, [("set", "new", None, None, None, None)]) == ("new", [], [])


def test_status_is_the_latest_event_by_date(spark):
    c = [("set", "applied", "2024-01-10", None, None, None), ("set", "interview", "2024-01-05", None, None, None), ("set", "interview", "2024-01-05", None, None, None)]
    status, events, _ = folded(spark, c)
    assert status == "applied" and len(events) == 3


def test_commands_on_changed_events_are_refused(spark):
    st = [("a", "applied", None, [("new", None), ("applied", "2024-01-02")])]
    assert folded(spark, [("edit", "applied", "2024-01-03", 1, "applied", "2024-01-02")], st)[1][1] == ("applied", "2024-01-03")
    assert folded(spark, [("edit", "offer", "2024-01-03", 1, "applied", "2024-01-09")], st)[2] == ["0: changed meanwhile"]
    assert folded(spark, [("edit", "new", None, 1, "applied", "2024-01-02")], st)[2] == ["0: event exists"]
    assert folded(spark, [("delete", None, None, 5, "applied", None)], st)[2] == ["0: no such event"]
    assert folded(spark, [("delete", None, None, 1, "applied", "2024-01-02")], st)[0] == "new"
    assert folded(spark, [("undo", None, None, None, None, None)], st)[2] == ["0: an application"]
    assert folded(spark, [("set", "nonsense", None, None, None, None)], st)[2] == ["0: unknown status"]


def test_undo(spark):
    st = [("a", "ignored", None, [("interesting", "2024-01-01"), ("ignored", "2024-01-02")]), ("b", "new", None, [])]
    assert folded(spark, [("undo", None, None, None, None, None)], st) == ("interesting", [("interesting", "2024-01-01")], [])


def test_imported_listing_takes_its_place(spark):
    old = spark.createDataFrame([("a", 0, ["u", "v"]), ("b", 1, ["w"]), ("c", 2, ["x"])], "id string, ord int, urls array<string>")
    new = spark.createDataFrame([("m", 0, ["v", "x"]), ("n", 0, ["z"])], "id string, ord int, urls array<string>")
    assert {(r["id"], r["ord"]) for r in identity.replace_or_add(old, new).collect()} == {("m", 0), ("b", 1), ("n", 3)}


def test_regions(spark):
    f = lambda label, code=None: spark.range(1).select(publish.region_allows(F.lit(label), F.lit(code), ("de", "germany"), ("europe",))).first()[0]
    assert f(None) and f("") and f("Germany only, Germany") and f("Europe / UK") and f("USA", "DE")
    assert not f("USA") and not f("Germany", "us")


def test_run_summary(spark):
    jobs = spark.createDataFrame([(True, [("a",), ("b",)]), (True, [("a",)]), (False, [("a",)])], "is_new boolean, sources array<struct<source:string>>")
    reports = spark.createDataFrame([("partial",), ("failed",), ("success",)], "status string")
    import json

    assert json.loads(publish.run_summary(jobs, reports, "r").first()[0]) == {"run_id": "r", "jobs_total": 3, "jobs_new": 2, "new_by_source": {"a": 2, "b": 1}, "sources_partial": 1, "sources_failed": 1}


def test_visible_pages(spark):
    html = "<title>T &amp; U</title><meta name='Author' content='me'><h1>Head</h1><p>Company: <b>Acme</b><p>Location<div>Fulda</div><script>no()</script>tail"
    r = spark.createDataFrame([(html,), (None,)], "h string").select(P.visible(F.col("h")).alias("p")).select("p.*").collect()
    assert (r[0]["title"], r[0]["headings"], r[0]["meta"]) == ("T & U", ["Head"], {"author": "me"})
    assert r[0]["lines"] == ["Head", "Company: Acme", "Location", "Fulda", "tail"] and r[1]["lines"] == []
    df = spark.createDataFrame([(r[0]["lines"],)], "l array<string>")
    get = lambda *labels: df.select(P.labelled_value(F.col("l"), list(labels))).first()[0]
    assert get("company") == "Acme" and get("location", "place") == "Fulda" and get("salary") is None


@pytest.mark.parametrize("code,url,lines,want", [(404, None, [], True), (410, None, [], True), (200, "https://a/search?q", [], True), (200, "https://a/1", ["Position closed"], True), (200, "https://a/1", ["open"], False), (500, None, ["position closed"], False), (None, None, None, False)])
def test_closed(spark, code, url, lines, want):
    df = spark.createDataFrame([(code, url, lines)], "c int, u string, l array<string>")
    assert df.select(P.is_closed(F.col("c"), F.col("u"), F.col("l"), ["/search"], ["position closed"])).first()[0] is want


def test_backup(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (1, None), (2, "b")], "k int, v string")
    backup.write(spark, {"t": df}, f"{tmp_path}/b")
    assert backup.verify(df, backup.restore(spark, f"{tmp_path}/b")["t"])
    df.limit(2).write.mode("overwrite").parquet(f"{tmp_path}/b/t")
    with pytest.raises(ValueError):
        backup.restore(spark, f"{tmp_path}/b")
    assert not backup.verify(df, df.distinct())


def test_entities_are_folded_in_one_pass(spark):
    """Entities that lie across batches, null ids, entities of no state and of no commands; numbers stay whole beside nulls."""
    state = spark.createDataFrame([*((f"e{k:03d}", "new", "2024-01-01", []) for k in range(60)), (None, "new", None, None), ("idle", None, None, None)], S)
    rows = [(f"e{k:03d}", s, "set" if s % 2 else "dance", "interesting", f"2024-02-{s + 1:02d}", None, None, None) for k in range(60) for s in range(9)]
    rows += [(None, 1, "set", "ignored", "2024-02-01", None, None, None), ("fresh", None, "dance", None, None, None, None, None), ("fresh", 3, "dance", None, None, None, None, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = history.fold(state, spark.createDataFrame(rows, C))
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = {r["id"]: r for r in got if r["id"] is not None}
    assert len(got) == 64 and "InPandas" not in out._jdf.queryExecution().analyzed().toString()
    for k in range(60):
        r = by[f"e{k:03d}"]
        assert [e["day"] for e in r["history"]] == ["2024-01-01", *(f"2024-02-{s + 1:02d}" for s in (1, 3, 5, 7))]
        assert r["status"] == "interesting" and r["refused"] == [f"{s}: unknown command" for s in (0, 2, 4, 6, 8)]
    assert by["fresh"]["refused"] == ["3: unknown command", "None: unknown command"] and by["fresh"]["status"] == "new"
    assert (by["idle"]["status"], by["idle"]["history"], by["idle"]["refused"]) == (None, None, [])
    assert sorted((r["status"], r["history"] is None) for r in got if r["id"] is None) == [("ignored", False), ("new", True)]
