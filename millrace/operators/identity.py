"""Which known entry a listing belongs to: by id, alias or URL, else by title under guards on decisions.

Candidates come from equi joins on exploded keys; the guards are residual predicates; the canonical entry is the
first of a window. All listings of a run are resolved against the state before it, so blocks need no order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

REPOST_DAYS = 30


def may_share(places: Column, remote: Column, other_places: Column, other_remote: Column) -> Column:
    """Every place is known to the other side (and there is one), or both are fully remote."""
    known = F.forall(places, lambda p: T.places_match(F.array(p), other_places))
    return (F.coalesce(remote, F.lit(False)) & F.coalesce(other_remote, F.lit(False))) | ((F.size(places) > 0) & known)


def resolve(listings: DataFrame, entries: DataFrame, aliases: DataFrame, now: Column) -> DataFrame:
    """(listing_id, canonical_id, folded): a row for each of listings(id, title, company, urls, locations, fully_remote,
    published_on) against entries(id, title, company, urls, locations, fully_remote, status, decided, applied,
    completed, active, first_seen, dated_on) and aliases(alias, id).

    Own candidates are the entry with the listing's id, the one its id is an alias of, and those with one of its URLs.
    If none of them is decided, entries with the same title are candidates too: with a matching company if they are
    active or their decision outlasts them; for a listing without a company, applications only, all of its places
    known. A decided entry takes a listing only if it knows its places; a completed application only within
    REPOST_DAYS. Canonical is the best of the applications, else of the decided, else of all: decided first, then
    oldest, then the listing's own id, then the smallest id. Undecided others fold into it. A listing without a
    candidate is its own canonical entry.
    """
    L = listings.select("id", T.normalize_title(F.col("title")).alias("tk"), T.normalize_company(F.col("company")).alias("ck"), "urls", "locations", "fully_remote", "published_on")
    E = entries.withColumn("tk", T.normalize_title(F.col("title"))).withColumn("ck", T.normalize_company(F.col("company")))
    by_id = L.select(F.col("id").alias("listing_id"), F.col("id").alias("entry_id"))
    by_alias = L.join(aliases.select(F.col("alias").alias("id"), F.col("id").alias("entry_id")), "id").select(F.col("id").alias("listing_id"), "entry_id")
    urls = E.select(F.col("id").alias("entry_id"), F.explode(F.array_distinct("urls")).alias("u"))
    by_url = L.select(F.col("id").alias("listing_id"), F.explode(F.array_distinct("urls")).alias("u")).where("u <> ''").join(urls, "u").select("listing_id", "entry_id")
    own = reduce(lambda a, b: a.unionByName(b), [by_id, by_alias, by_url]).distinct()
    facts = E.select(F.col("id").alias("entry_id"), F.col("decided").alias("e_decided"), F.col("applied").alias("e_applied"), F.col("completed").alias("e_completed"), F.col("active").alias("e_active"), F.col("first_seen").alias("e_first"), F.col("locations").alias("e_places"), F.coalesce("fully_remote", F.lit(False)).alias("e_remote"), F.col("dated_on").alias("e_dated"), F.col("status").alias("e_status"), F.col("tk"), F.col("ck").alias("e_ck"))
    own = own.join(facts.drop("tk", "e_ck"), "entry_id").withColumn("by_title", F.lit(False))
    settled = own.groupBy("listing_id").agg(F.bool_or("e_decided").alias("own_decided"))
    # title candidates of the listings whose own entries are undecided
    free = L.withColumnRenamed("id", "listing_id").where("tk <> ''").join(settled, "listing_id", "left").where("not coalesce(own_decided, false)")
    t = free.join(facts, "tk")
    in_time = ~F.col("e_completed") | F.coalesce(F.abs(F.date_diff(F.coalesce("published_on", now), "e_dated")) <= REPOST_DAYS, F.lit(False))
    shares = ~F.col("e_decided") | may_share(F.col("locations"), F.col("fully_remote"), F.col("e_places"), F.col("e_remote"))
    lasting = F.col("e_active") | (F.col("e_status") == "ignored") | F.col("e_applied")
    named = (F.col("ck") != "") & T.companies_match(F.col("ck"), F.col("e_ck")) & lasting & shares
    unnamed = (F.col("ck") == "") & F.col("e_applied") & (F.size("locations") > 0) & F.forall("locations", lambda p: T.places_match(F.array(p), F.col("e_places")))
    t = t.where(in_time & (named | unnamed)).select(*[c for c in own.columns if c != "by_title"]).withColumn("by_title", F.lit(True))
    t = t.join(own.select("listing_id", "entry_id"), ["listing_id", "entry_id"], "left_anti")
    # a decided title match needs to know the places of the listing's own entries as well
    own_places = own.groupBy("listing_id").agg(F.array_distinct(F.flatten(F.collect_list("e_places"))).alias("own_places"), F.bool_and("e_remote").alias("own_remote"))
    t = t.join(own_places, "listing_id", "left")
    t = t.where(~F.col("e_decided") | F.col("own_places").isNull() | (F.size("own_places") == 0) | may_share(F.col("own_places"), F.col("own_remote"), F.col("e_places"), F.col("e_remote"))).drop("own_places", "own_remote")
    every = own.unionByName(t)
    best = Window.partitionBy("listing_id").orderBy(F.desc("e_applied"), F.desc("e_decided"), F.col("e_first").asc_nulls_last(), F.col("entry_id") != F.col("listing_id"), "entry_id")
    ranked = every.withColumn("rn", F.row_number().over(best))
    first = ranked.where("rn = 1").select("listing_id", F.col("entry_id").alias("canonical_id"), F.col("e_decided").alias("c_decided"), F.col("e_places").alias("c_places"), F.col("e_remote").alias("c_remote"))
    others = ranked.where("rn > 1 and not e_decided").join(first, "listing_id")
    fold = others.where(~F.col("by_title") | ~F.col("c_decided") | may_share(F.col("e_places"), F.col("e_remote"), F.col("c_places"), F.col("c_remote")))
    folded = fold.groupBy("listing_id").agg(F.array_sort(F.collect_set("entry_id")).alias("folded"))
    out = L.select(F.col("id").alias("listing_id")).join(first.select("listing_id", "canonical_id"), "listing_id", "left").join(folded, "listing_id", "left")
    return out.select("listing_id", F.coalesce("canonical_id", "listing_id").alias("canonical_id"), F.coalesce("folded", F.array().cast("array<string>")).alias("folded"))


def replace_or_add(listings: DataFrame, imported: DataFrame) -> DataFrame:
    """listings(id, urls, ...) with the imported ones in place of those that share a URL with them, at their place (ord)."""
    mine = imported.select(F.col("id").alias("new_id"), F.explode("urls").alias("u"))
    hit = listings.select("id", "ord", F.explode("urls").alias("u")).join(mine, "u").groupBy("new_id").agg(F.min("ord").alias("at"), F.collect_set("id").alias("gone"))
    kept = listings.join(hit.select(F.explode("gone").alias("id")).distinct(), "id", "left_anti")
    last = listings.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    new = imported.drop("ord").join(hit.select(F.col("new_id").alias("id"), "at"), "id", "left").crossJoin(F.broadcast(last))  # one row, by its aggregate
    return kept.unionByName(new.withColumn("ord", F.coalesce("at", F.col("last") + 1)).select(*kept.columns))
