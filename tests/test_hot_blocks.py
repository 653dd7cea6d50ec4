"""Greedy merging of a title that very many rows have: split into groups that can't meet, with the same rows."""

import random

from pyspark.sql import functions as F

from millrace.operators import components, resolve

SCHEMA = "id string, ord long, title string, company string, locations array<string>, sources array<struct<source:string,url:string>>, description string, fully_remote boolean, is_new boolean"
COMPANIES = ["Acme Systems", "Acme", "Acme Systems Nord", "Delta Group", "Delta Holding", "Delta", "Omega Werke", "Omega", "Nordlicht", "Verlag Nordlicht Hamburg", "Blau und Weiss", "Ab", "Ab cd"] + [f"Firma{k} Handel" for k in range(25)]
PLACES = ["Fulda", "Fulda Mitte", "Berlin", "Berlin Mitte", "Rom", "Rome Nord", "Kassel", "Bad Kassel Sued", "", "Ulm"] + [f"Ort{k:03d}" for k in range(30)]


def listings(spark, n=400, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        title = "Developer" if k % 4 else f"Title {k % 24}"
        sources = [(s, f"{s}/{k}") for s in r.sample("abcde", r.randint(1, 2))]
        rows.append((f"l{k}", k, title, r.choice(COMPANIES), r.sample(PLACES, r.randint(0, 2)), sources, "d" * r.randint(0, 30), r.random() < 0.1, r.random() < 0.5))
    return spark.createDataFrame(rows, SCHEMA)


def shown(df):
    return sorted(map(str, df.select("id", "ord", "company", "locations", "sources", "description", "fully_remote", "is_new").collect()))


def test_split_blocks_give_the_same_rows(spark):
    df = listings(spark)
    whole = shown(resolve.merge_duplicates(df, most_rows=10**9))
    assert 50 < len(whole) < 390
    assert shown(resolve.merge_duplicates(df, most_rows=5)) == whole
    assert resolve.merge_duplicates(df.limit(0), most_rows=5).count() == 0


def test_groups_are_as_small_as_what_may_meet(spark):
    from millrace.functions import text as T

    df = listings(spark, 600).where("title = 'Developer'").select(F.col("ord").alias("row"), F.lit("developer").alias("block"), T.normalize_company(F.col("company")).alias("company"), F.transform("locations", lambda x: T.normalize_place(x)).alias("places"), F.col("fully_remote").alias("remote"))
    got = {x["row"]: x["group"] for x in resolve.match_groups(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    groups = frozenset(T.GROUP_WORDS)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def link(meets):
        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                if meets(i, a, j, b):
                    root[find(i)] = find(j)

    link(lambda i, a, j, b: resolve._same_company(a["company"], b["company"], groups))
    chain = [find(i) for i in range(len(rows))]
    root[:] = range(len(rows))
    link(lambda i, a, j, b: chain[i] == chain[j] and (resolve._same_place(a["places"], b["places"]) or a["remote"] and b["remote"]))
    want = {}
    for i, a in enumerate(rows):
        want.setdefault(find(i), set()).add(a["row"])
    have = {}
    for row, group in got.items():
        have.setdefault(group, set()).add(row)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values())) and max(map(len, want.values())) < len(rows) / 3


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (9, 9), (7, 5), (None, 1)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5)}
