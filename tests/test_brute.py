"""Queries that SQL can't express, against plain Python over whole tables, and operators without a query."""

import html
import json
import re

import pytest
from oracle import connect
from pyspark.sql import functions as F

from millrace.operators import cards, datasets
from millrace.plans import registry
from millrace.sources import segments, union

SF = "/root/testdata/sf0.001"


def test_dedup_merge_is_the_greedy_pass_over_all_rows(spark):
    rows = connect(SF).sql("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part ORDER BY p_partkey").fetchall()
    words = lambda t: " ".join(re.findall(r"[a-z0-9+#.]+", t.lower()))
    kept = []
    for key, name, brand, kind, size in rows:
        row = {"id": f"p{key}", "title": words(name), "company": " ".join(re.findall("[a-z0-9]+", brand.lower())), "places": [kind], "sources": {(key % 4, key)}, "remote": key % 4 == 2, "text": size}
        for old in kept:
            apart = not {s for s, _ in old["sources"]} & {key % 4}
            if old["title"] == row["title"] and old["company"] == row["company"] and apart and (kind in old["places"] or old["remote"] and row["remote"]):
                old["remote"] = row["remote"] if row["text"] > old["text"] else old["remote"]
                old["text"] = max(old["text"], row["text"])
                old["sources"] |= row["sources"]
                old["places"] += [p for p in row["places"] if p not in old["places"]]
                break
        else:
            kept.append(row)
    got = registry.QUERIES["dedup_merge"](spark, SF).collect()
    assert sorted((r["id"], r["n_sources"], r["longest"], r["n_places"]) for r in got) == sorted((k["id"], len(k["sources"]), k["text"], len(k["places"])) for k in kept)


def test_history_fold_is_the_replay_of_all_commands(spark):
    commands = connect(SF).sql("SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') FROM orders ORDER BY o_orderkey").fetchall()
    state = {str(k): ["new", [], 0] for (k,) in connect(SF).sql("SELECT c_custkey FROM customer").fetchall()}
    for customer, key, s, day in commands:
        entry = state.setdefault(str(customer), ["new", [], 0])
        status, events, _ = entry
        if key % 10 == 0:
            if status == "ignored" and events and events[-1][0] == "ignored":
                events.pop()
            else:
                entry[2] += 1
        else:
            new = ("ignored" if s == "F" else "interesting", day)
            if not events and status != new[0]:
                events.append((status, "1992-01-01"))
            if new not in events:
                events.append(new)
        dated = sorted(range(len(events)), key=lambda k: (events[k][1] is not None, events[k][1] or "", k))
        entry[0] = events[dated[-1]][0] if events else "new"
    got = {r["id"]: (r["status"], r["events"], r["refused"]) for r in registry.QUERIES["history_fold"](spark, SF).collect()}
    assert got == {k: (status, len(events), refused) for k, (status, events, refused) in state.items()}


def test_html_text_without_a_parser(spark):
    pages = dict(connect(SF).sql("SELECT page_id, html FROM pages").fetchall())
    for r in registry.QUERIES["html_text"](spark, SF).collect():
        page = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", lambda m: "\0" if m[1] else "\1", pages[r["page_id"]] or "")
        nodes = [html.unescape(x).strip() for x in re.split(r"(?s)</?[a-zA-Z][^>]*>|[\0\1]", page)]
        assert r["text"] == " ".join(n for n in nodes if n)


def write_pages(folder, name, *pages):
    (folder / name).mkdir()
    for k, page in enumerate(pages):
        (folder / name / f"{k}.json").write_text(page if isinstance(page, str) else json.dumps(page))


def test_blocked_and_endless_segments_fail(spark, tmp_path):
    record = {"records": [{"id": 1}]}
    write_pages(tmp_path, "a", {**record, "next": False})
    write_pages(tmp_path, "b", record, {"status": 429})
    write_pages(tmp_path, "c", {**record, "next": False})
    write_pages(tmp_path, "d", record, record, {**record, "next": False})
    count = lambda **kw: tuple(segments.read_segments(spark, str(tmp_path), **kw)[1].first())
    assert count() == (6, 1, 4)
    assert count(max_pages=2) == (5, 2, 4)  # d is not at its end after two pages
    assert count(in_order=True) == (2, 3, 4)  # what follows the 429 is not asked for


def test_cursors_lead_from_page_to_page(spark, tmp_path):
    write_pages(tmp_path, "a", {"records": [{"id": 1}], "next": "after-1"})
    (tmp_path / "a" / "after-1.json").write_text(json.dumps({"records": [{"id": 2}], "next": "after-2"}))
    (tmp_path / "a" / "after-2.json").write_text(json.dumps({"records": []}))
    rows, report = segments.read_segments(spark, str(tmp_path))
    assert sorted(json.loads(r["payload"])["id"] for r in rows.collect()) == [1, 2] and tuple(report.first()) == (2, 0, 1)


def test_snapshots_are_replaced_as_a_whole(spark, tmp_path):
    path, default = str(tmp_path / "s"), spark.range(0)
    assert datasets.read_snapshot(spark, path, default).count() == 0
    datasets.publish_snapshot(spark.range(3), path)
    old = datasets.read_snapshot(spark, path, default)
    datasets.publish_snapshot(spark.range(5), path)
    assert datasets.read_snapshot(spark, path, default).count() == 5 and old.count() == 3
    datasets.append_ledger(f"{path}/ledger", spark.range(2))
    datasets.append_ledger(f"{path}/ledger", spark.range(2))
    assert spark.read.parquet(f"{path}/ledger").count() == 4
    assert datasets.stored_objects(spark, f"{path}/ledger").where("bytes > 0").count() >= 2


def test_frontiers_are_apart(spark):
    df = spark.createDataFrame([(s, i, o) for s, olds in (("a", [0, 1, 1, 0]), ("b", [1, 0, 1, 0])) for i, o in enumerate(olds)], "source string, page int, old int")
    got = union.date_frontier(df, "page", F.col("old") == 1, by=("source",)).groupBy("source").count().collect()
    assert dict(map(tuple, got)) == {"a": 3, "b": 4}


def test_choice_of_sources():
    known = ["a", "b", "c", "d"]
    assert cards.chosen_sources(known) == set(known) and cards.chosen_sources(known, only=["a"]) == {"a"} and cards.chosen_sources(known, exclude=["a"]) == {"b", "c", "d"}
    assert cards.chosen_sources(known, groups={"c d": ["c"]}) == {"a", "b", "c"} and cards.chosen_sources(known, groups={"c d": None}) == set(known)
    for bad in ({"only": ["x"]}, {"exclude": known}, {"groups": {"c d": ["x"]}}, {"exclude": ["x"]}):
        with pytest.raises(ValueError):
            cards.chosen_sources(known, **bad)


def test_limits():
    defaults, ceilings = {"job": 1.0, "day": 2.0, "calls": 5}, {"job": 3.0, "day": 9.0, "calls": 10}
    check = lambda **v: cards.checked_limits(v, defaults, ceilings, ("job", "day"), ("calls",))
    assert check() == defaults and check(job=2, calls=0) == {"job": 2, "day": 2.0, "calls": 0}
    for bad in ({"job": 2.5}, {"job": 0}, {"day": 10}, {"calls": 1.5}, {"calls": True}, {"x": 1}, {"job": "1"}):
        with pytest.raises(ValueError):
            check(**bad)
