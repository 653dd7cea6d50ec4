"""Row numbers and chunks of whole tables, against one pass over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ledger, ranks


def plain_chunks(sizes, most_items, most_size):
    out, n, total, chunk = [], 0, 0, 0
    for s in sizes:
        s = s or 0
        if n and (n == most_items or total + s > most_size):
            n, total, chunk = 0, 0, chunk + 1
        n, total = n + 1, total + s
        out.append(chunk)
    return out


@pytest.mark.parametrize("most_items, most_size, slice_rows", [(5, 100, 7), (5, 100, 5), (1, 100, 3), (12, 60, 1000), (4, 10**9, 9)])
def test_chunks_of_a_hot_key(spark, most_items, most_size, slice_rows):
    r = random.Random(5)
    rows = [("hot", k, r.choice([1, 5, 20, 60, 150, None]), "x") for k in range(700)] + [(f"k{j}", k, r.choice([10, 40]), "y") for j in range(20) for k in range(j)] + [(None, k, 30, "z") for k in range(11)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "who string, n int, size int, `a.b` string")
    got = {(x["who"], x["n"]): x["chunk"] for x in ledger.chunks(df, "who", "n", "size", most_items, most_size, slice_rows).collect()}
    want = {}
    for who in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == who), key=lambda x: x[1])
        want |= {(who, x[1]): c for x, c in zip(own, plain_chunks([x[2] for x in own], most_items, most_size))}
    assert got == want


def test_chunks_of_nothing_and_of_fractions(spark):
    df = spark.createDataFrame([], "who string, n int, size double")
    assert ledger.chunks(df, "who", "n", "size").columns == ["who", "n", "size", "chunk"] and ledger.chunks(df, "who", "n", "size").count() == 0
    df = spark.createDataFrame([("a", k, 0.5) for k in range(7)], "who string, n int, size double")
    assert [x["chunk"] for x in ledger.chunks(df, "who", "n", "size", 10, 1).orderBy("n").collect()] == [0, 0, 1, 1, 2, 2, 3]
    with pytest.raises(ValueError):
        ledger.chunks(df, "who", "n", "size", 10, 1, 5)


def test_numbers_over_all_rows(spark):
    r = random.Random(6)
    rows = [(r.randint(0, 50), k) for k in range(997)]
    df = spark.createDataFrame(rows, "v int, id int").repartition(7)
    got = ranks.numbered(df.orderBy(F.desc("v"), "id"))
    assert [(x["v"], x["id"]) for x in sorted(got.collect(), key=lambda x: x["place"])] == sorted(rows, key=lambda x: (-x[0], x[1]))
    assert sorted(x["place"] for x in got.collect()) == list(range(1, 998))
    assert ranks.numbered(df.limit(0).orderBy("id")).count() == 0
