"""Walks of sessions: cursors, tokens, frontiers and failures, in one go and over restarts."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.session import shared_base
from millrace.sources import walks


def page(k, n=2, more=True, token="t", day="2024-05-01"):
    return json.dumps({"records": [{"id": k * 10 + i, "published": day} for i in range(n)], "next": str(k + 1) if more else False, "token": token})


WALKS = {
    "whole": [page(0), page(1), page(2, 1, False)],
    "cursors": None,
    "old": [page(0, day="2024-05-01"), page(1, day="2024-01-01"), page(2, day="2024-05-01"), page(3, day="2024-01-02"), page(4, day="2024-01-01"), page(5)],
    "lost": [page(0), page(1, token="other"), page(2, more=False)],
    "broken": [page(0), "{not json", page(2, more=False)],
    "endless": [page(k) for k in range(9)],
    "empty": [page(0, 0)],
    "missing": [page(0)],
}


@pytest.fixture
def folder(spark):
    import uuid

    rows = [(w, str(k), b) for w, pages in WALKS.items() for k, b in enumerate(pages or [])]
    rows += [("cursors", "0", json.dumps({"records": [{"id": 1}], "next": "ab12"})), ("cursors", "ab12", json.dumps({"records": ["plain", None]}))]
    path = f"{shared_base(spark)}/walks-{uuid.uuid4().hex}"
    walks.write_pages(spark.createDataFrame(rows, "walk string, page string, body string"), f"{path}/pages")
    return path


def walked(spark, folder, out, batches=None, **options):
    stream = walks.read_walks(spark, f"{folder}/pages", frontier="2024-02-01", maxPages=7, **options)
    return walks.run_walks(stream, f"{folder}/{out}", f"{folder}/{out}-ckpt", batches)


def test_one_go_and_restarts_give_the_same(spark, folder):
    once = sorted(map(str, walked(spark, folder, "once", pagesPerBatch=50).collect()))
    for batches in (1, 1, 2, None):
        parts = walked(spark, folder, "parts", batches, pagesPerBatch=1)
    assert sorted(map(str, parts.collect())) == once
    assert walked(spark, folder, "parts", pagesPerBatch=1).count() == len(once)  # nothing is left, nothing comes twice


def test_where_walks_end(spark, folder):
    got = walked(spark, folder, "ends", pagesPerBatch=3)
    n = {r["walk"]: r["n"] for r in got.where("error is null").groupBy("walk").agg(F.count("*").alias("n")).collect()}
    assert n == {"whole": 5, "cursors": 3, "old": 10, "lost": 2, "broken": 2, "endless": 14, "missing": 2}
    errors = {r["walk"]: r["error"] for r in got.where("error is not null").collect()}
    assert errors == {"lost": "another session", "broken": "JSONDecodeError", "endless": "page limit", "missing": "FileNotFoundError"}
    assert [r["ord"] for r in got.where("walk = 'whole'").orderBy("ord").collect()] == [0, 1, 2, 3, 4]
    assert [json.loads(r["payload"]) for r in got.where("walk = 'cursors'").orderBy("ord").collect()] == [{"id": 1}, "plain", None]


def test_folders_do_not_grow_with_the_pages(spark, folder):
    from pathlib import Path

    rows = spark.range(500).selectExpr("'w' as walk", "cast(id as string) as page", "concat('{\"records\": [', id, '], \"next\": ', if(id < 499, concat('\"', id + 1, '\"'), 'false'), '}') as body")
    walks.write_pages(rows, f"{folder}/many")
    assert len(list(Path(f"{folder}/many".removeprefix("file://")).glob("walk=w/*"))) == walks.BUCKETS
    out = walks.run_walks(walks.read_walks(spark, f"{folder}/many", pagesPerBatch=500), f"{folder}/many-out", f"{folder}/many-ckpt")
    assert [r["payload"] for r in out.orderBy("ord").collect()] == [str(k) for k in range(500)]
