"""Listings attached to applications: what is kept, in which order, and what is refused."""

import json


from millrace.operators import cards, enrichment

STATE = "id string, application boolean, documents boolean, linked_ids array<string>, urls array<string>, names array<string>, locations array<string>, active boolean, note string, history array<struct<status:string,day:string>>"


def test_attached_listings_stay_whole(spark):
    rows = [
        ("app", True, False, None, ["u1"], ["One"], ["Fulda"], False, "mine", [("applied", "2024-01-01")]),
        ("app2", True, True, ["x"], ["u9"], [], [], True, None, None),
        ("a", False, False, None, ["u2", "u1", None, ""], ["Two", "Other", "n", "m"], ["Kassel", "Fulda"], None, "remember", [("interesting", "2024-02-02"), ("ignored", None)]),
        ("b", False, None, None, ["u3"], ["Three"], None, False, "b", []),
        ("c", False, True, None, ["u4"], ["Four"], [], True, "c", None),
        ("d", False, False, None, ["u5"], ["Five"], ["Ulm"], True, "d", None),
    ]
    state = spark.createDataFrame(rows, STATE)
    asked = [(1, "b", "none"), (2, "b", "app"), (3, "a", "app"), (4, "a", "app"), (5, "a", "app2"), (6, "c", "app"), (7, "zz", "app"), (8, "app2", "app"), (9, "app", "app"), (10, "x", "app2"), (11, "d", "app2"), (12, "d", "b")]
    out, report = cards.attach_listings(state, spark.createDataFrame(asked, "ord int, source_id string, target_id string"))
    assert [r["outcome"] for r in report.orderBy("ord").collect()] == ["no application", "linked", "linked", "already", "no source", "an application", "no source", "an application", "same", "already", "linked", "no application"]
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {"app", "app2", "c"}
    app = got["app"]
    assert (app["linked_ids"], app["urls"], app["names"], app["locations"], app["active"], app["note"]) == (["b", "a"], ["u1", "u3", "u2"], ["One", "Three", "Two"], ["Fulda", "Kassel"], True, "mine")
    kept = json.loads(app["linked_entries"]["a"])
    assert kept["note"] == "remember" and kept["history"] == [{"status": "interesting", "day": "2024-02-02"}, {"status": "ignored"}] and kept["urls"][0] == "u2"
    assert got["app2"]["urls"] == ["u9", "u5"] and got["app2"]["names"] == ["Five"] and got["app2"]["linked_ids"] == ["x", "d"]
    assert got["c"]["linked_entries"] == {} and got["c"]["active"]
    # a later step adds to what is kept
    again, _ = cards.attach_listings(out, spark.createDataFrame([(1, "c", "app")], "ord int, source_id string, target_id string"))
    assert again.where("id = 'app'").first()["linked_entries"].keys() == {"a", "b"}
    nothing, report = cards.attach_listings(state, spark.createDataFrame([], "ord int, source_id string, target_id string"))
    assert nothing.count() == 6 and report.count() == 0


def test_report_of_late_details(spark):
    due = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "source string, id int")
    got = enrichment.enrichment_report(due, due.where("source = 'a' and id = 2").union(spark.createDataFrame([("c", 9)], due.schema)), ["a", "b", "c", "a"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 1), ("b", 0, 1), ("c", 0, 0)]
