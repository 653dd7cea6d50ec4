"""Duplicates and identities: first-wins deduplication, greedy merging in blocks, identity resolution."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.components import connected_components
from millrace.session import written


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order. dropDuplicates keeps any; this keeps the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def unique_records(df: DataFrame, identifier: Column, order: Column) -> DataFrame:
    """First record of each identifier; records without one all stay, after the others."""
    d = df.withColumn("__id", identifier)
    known = first_wins(d.where(F.col("__id").isNotNull() & (F.col("__id") != "")), ["__id"], [order])
    return known.unionByName(d.where(F.col("__id").isNull() | (F.col("__id") == ""))).drop("__id")


def merge_duplicates(listings: DataFrame, group_words: Iterable[str] = T.GROUP_WORDS, most_rows: int = 1000) -> DataFrame:
    """Greedy merging of listings(id, ord, title, company, locations, sources array<struct<source,url>>, description,
    fully_remote, is_new) over sources, in the order of ord.

    Rows meet only in one block, their normalised title. A row joins the first earlier one of its block that has
    no source in common, a matching company, and a shared place or both fully remote; the merged row keeps the id
    and the longer description's fields and unites places and sources. The comparison is with the row as merged
    so far, so it can't be a join; blocks run one after another in tasks that share them out. Rows with an empty title or company key
    meet nothing and take no part in the grouping. Blocks of more than most_rows rows are split into the groups of
    match_groups, which gives the same rows.
    """
    keyed = listings.select("*", T.normalize_title(F.col("title")).alias("__block"), T.normalize_company(F.col("company")).alias("__company"))
    alone = (F.col("__block") == "") | (F.col("__company") == "")
    singles = keyed.where(alone).drop("__block", "__company")
    # blocks of one row need no Python; their sizes are counted without the rows
    sizes = keyed.where(~alone).groupBy("__block").agg(F.count("*").alias("__n"))
    sized = keyed.where(~alone).join(sizes, "__block").withColumn("__places", F.transform("locations", lambda x: T.normalize_place(x)))
    lone = sized.where("__n = 1").select(*listings.columns)
    groups = frozenset(group_words)
    few = sized.where(F.col("__n").between(2, most_rows)).withColumn("__group", F.lit(0).cast("long")).drop("__n")
    hot = written(sized.where(F.col("__n") > most_rows).drop("__n").withColumn("__row", F.monotonically_increasing_id()), "hot-blocks")
    many = few
    if not hot.isEmpty():
        found = match_groups(hot.select(F.col("__row").alias("row"), F.col("__block").alias("block"), F.col("__company").alias("company"), F.col("__places").alias("places"), F.col("fully_remote").alias("remote")), group_words)
        many = few.unionByName(hot.join(found.select(F.col("row").alias("__row"), F.col("group").alias("__group")), "__row").drop("__row"))

    # dealt and sorted by group, so a task goes through its groups without anything set up for one of them
    dealt = many.repartition("__block", "__group").sortWithinPartitions("__block", "__group", "ord")
    return singles.unionByName(lone).unionByName(dealt.mapInArrow(_merger(listings.columns, groups), listings.schema))


def match_groups(rows: DataFrame, group_words: Iterable[str] = T.GROUP_WORDS) -> DataFrame:
    """rows(row, block, company, places, remote) -> (row, group): rows of different groups can never come together by greedy
    merging, whatever has been merged before.

    A merged row has the company of one of its members, so it matches only companies that are linked with theirs by a chain
    of matches; it has its members' places, and is remote only if one of them is. So first the distinct companies of a
    block are linked, through the words and leading words by which names match, then the rows of a chain through their
    places, the places they contain, and being remote. Links are equalities of keys, each only where somebody has the key.
    """
    node = lambda kind, *columns: F.xxhash64(F.lit(kind), *columns)
    names = written(rows.select("block", "company").distinct(), "block-companies")
    words = F.split("company", " ")
    leading = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    keys = names.select("block", F.col("company").alias("long"), F.explode(F.array_distinct(F.concat(leading, words))).alias("company")).where("length(company) >= 5 and company <> long")
    by_key = keys.join(names, ["block", "company"], "left_semi").select(node("company", "block", "long").alias("a"), node("company", "block", "company").alias("b"))
    rest = F.array(*[F.lit(w) for w in sorted(group_words)]).cast("array<string>")
    own = (F.length(F.get(words, F.lit(0))) >= 3) & (F.size(F.array_except(F.slice(words, F.lit(2), F.size(words)), rest)) == 0)
    by_group = names.where(own).select(node("company", "block", "company").alias("a"), node("first word", "block", F.get(words, F.lit(0))).alias("b"))
    chains = connected_components(by_key.unionByName(by_group)).withColumnRenamed("node", "name")
    chained = rows.withColumn("name", node("company", "block", "company")).join(chains, "name", "left").select("row", "remote", "places", F.coalesce("component", "name").alias("chain"))
    chained = written(chained, "block-chains")
    there = written(chained.select("row", "chain", F.explode(F.array_distinct("places")).alias("place")).where("place <> ''"), "block-places")
    places = there.select("chain", "place").distinct()
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.length("place") - 4), lambda k: F.transform(F.sequence(F.lit(5), F.length("place") - k + 1), lambda n: F.substring("place", k, n))))
    inside = places.where("length(place) > 5").select("chain", F.col("place").alias("outer"), F.explode(F.array_distinct(inner)).alias("place")).where("place <> outer")
    links = there.select(node("row", "row").alias("a"), node("place", "chain", "place").alias("b"))
    links = links.unionByName(inside.join(places, ["chain", "place"], "left_semi").select(node("place", "chain", "outer").alias("a"), node("place", "chain", "place").alias("b")))
    links = links.unionByName(chained.where("remote").select(node("row", "row").alias("a"), node("remote", "chain").alias("b")))
    parts = connected_components(links)
    return chained.withColumn("node", node("row", "row")).join(parts, "node", "left").select("row", F.coalesce("component", "node").alias("group"))


def _same_company(a: str, b: str, groups: frozenset) -> bool:
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if len(short) >= 5 and (long.startswith(f"{short} ") or short in long.split()):
        return True
    x, y = a.split(), b.split()
    return x[0] == y[0] and len(x[0]) >= 3 and {*x[1:], *y[1:]} <= groups


def _same_place(a: list[str], b: list[str]) -> bool:
    return any(x == y or len(x) >= 5 and x in y or len(y) >= 5 and y in x for x in a for y in b if x and y)


def _merge_block(block: list[dict], groups: frozenset) -> list[dict]:
    """Rows of a group, in order, as they are merged."""
    kept: list[dict] = []
    for row in block:
        row = row | {c: row[c] if row[c] is not None else [] for c in ("sources", "locations", "__places")}
        own = {s["source"] for s in row["sources"]}
        at = next((k for k, x in enumerate(kept) if not own & {s["source"] for s in x["sources"]} and _same_company(row["__company"], x["__company"], groups) and (_same_place(row["__places"], x["__places"]) or row["fully_remote"] and x["fully_remote"])), None)
        if at is None:
            kept.append(row)
            continue
        old = kept[at]
        rich = row if len(row["description"] or "") > len(old["description"] or "") else old
        sources = list({(s["source"], s["url"]): s for s in reversed([*old["sources"], *row["sources"]])}.values())[::-1]
        kept[at] = rich | {"id": old["id"], "ord": old["ord"], "locations": list(dict.fromkeys(old["locations"] + row["locations"])), "__places": list(dict.fromkeys(old["__places"] + row["__places"])), "sources": sources, "is_new": bool(old["is_new"] or row["is_new"])}
    return kept


def _merger(columns: list[str], groups: frozenset, most: int = 10_000):
    """Rows that are sorted by group, in batches that may end within one; most: rows of a batch that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, done, schema = None, [], [], None
        for batch in batches:
            schema = pa.schema([batch.schema.field(c) for c in columns])
            for row in batch.to_pylist():
                if (key := (row["__block"], row["__group"])) != now:
                    done += _merge_block(block, groups)
                    now, block = key, []
                    if len(done) >= most:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done = []
                block.append(row)
        done += _merge_block(block, groups)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def alias_closure(edges: DataFrame, src: str = "alias", dst: str = "canonical") -> DataFrame:
    """(id, root): where chains of aliases end. Pointers are doubled, so n edges take about log n rounds, after which
    every chain has ended or is on a cycle; ids that lead to a cycle end at the cycle's smallest id. The table is written
    in the shared folder between rounds."""
    keep = lambda df: written(df, "aliases")
    step = first_wins(edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("id"), F.col(dst).alias("to")), ["id"], [F.col("to")])
    step = keep(step.withColumn("low", F.least("id", "to")))
    for _ in range(int(step.count()).bit_length() + 1):
        nxt = step.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        step = keep(step.join(nxt, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("to2").isNotNull().alias("moved")))
        moved = not step.where("moved").isEmpty()
        step = step.drop("moved")
        if not moved:
            break
    ends = step.select(F.col("id").alias("to"), F.col("low").alias("ring_low"))  # only ids on a cycle still point on
    return step.join(ends, "to", "left").select("id", F.coalesce("ring_low", "to").alias("root"))


def preferred(df: DataFrame, keys: list, classes: list[tuple[str, int]], ties: list) -> DataFrame:
    """For each key the row of the best class (lowest number whose condition holds), then by ties."""
    rank = F.coalesce(*[F.when(F.expr(c), n) for c, n in classes], F.lit(99))
    return first_wins(df.withColumn("__class", rank), keys, [F.col("__class"), *ties]).drop("__class")


def sources_succeeded(known: Column, run: Column, ok: Column) -> Column:
    """A row's absence counts only if the run searched some of its sources and all of these succeeded."""
    searched = F.array_intersect(known, run)
    return (F.size(searched) > 0) & (F.size(F.array_except(searched, ok)) == 0)
