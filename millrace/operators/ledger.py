"""Costs: calendar budgets in a local time zone, running budgets, bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from millrace.operators.ranks import numbered
from millrace.session import written


def spent(ledger: DataFrame, at: str, cost: str, moment: Column, zone: str = "Europe/Berlin") -> DataFrame:
    """One row: sums since the start of the moment's day and month in a zone; 0 where nothing was spent. at and moment
    are UTC without zone."""
    start = lambda unit: F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(moment, zone)), zone)
    t = F.col(at).cast("timestamp")
    until = t <= moment.cast("timestamp")
    total = lambda unit: F.coalesce(F.sum(F.when(until & (t >= start(unit)), F.col(cost))), F.lit(0))
    return ledger.where(t >= start("month")).agg(total("day").alias("spent_today"), total("month").alias("spent_month"))


def within_budget(ledger: DataFrame, keys: list[str], order: list[str], cost: str, limit: float) -> DataFrame:
    """Calls that may start: what was spent before them in their group is under the limit (so the last may overshoot)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ledger.withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0).cast(ledger.schema[cost].dataType))).where(F.col("spent_before") < limit)


def chunks(items: DataFrame, key: str, order: str, size: str, most_items: int = 10, most_size: int = 6000, slice_rows: int = 1000) -> DataFrame:
    """items with chunk (from 0): consecutive items of a key in greedy chunks of at most most_items and most_size in all; an
    item that is larger than that stands alone. A null size counts as 0, a null key is a key.

    Where a chunk ends depends on where it began, yet not on more: so each item has a next one that would begin another
    chunk if it began one itself, found among the most_items after it. A key is cut into slices of slice_rows. A chunk
    reaches at most most_items - 1 rows into a slice, so a slice is a function of few values, from the row where its
    first chunk begins to the row of the next slice where one does. These functions are composed over the slices by
    doubling, which tells where each slice begins and with which chunk; a key with all rows is dealt like many keys.
    """
    if slice_rows < most_items:
        raise ValueError("a slice holds a chunk at least")
    whole = isinstance(items.schema[size].dataType, IntegralType)
    own = items.select(F.struct(*(F.col(f"`{c}`") for c in items.columns)).alias("row"), F.col(key).alias("key"), F.col(order).alias("order"), F.coalesce(F.col(size).cast("long" if whole else "double"), F.lit(0)).alias("size"))
    placed = numbered(own.orderBy("key", "order"), "at")
    firsts = placed.groupBy("key").agg(F.min("at").alias("first"))
    placed = placed.alias("p").join(firsts.alias("f"), F.expr("p.key <=> f.key")).select("p.key", "row", "size", (F.col("at") - F.col("first")).alias("pos"))
    # each slice, and the sizes of the rows that follow it
    number, ahead = F.expr(f"pos div {slice_rows}"), (F.col("pos") >= slice_rows) & (F.col("pos") % slice_rows < most_items)
    here, before = F.struct(number.alias("slice"), F.lit(False).alias("ahead")), F.struct((number - 1).alias("slice"), F.lit(True).alias("ahead"))
    dealt = placed.withColumn("to", F.explode(F.when(ahead, F.array(here, before)).otherwise(F.array(here))))
    cut = dealt.groupBy("key", F.col("to.slice").alias("slice")).agg(F.array_sort(F.collect_list(F.when(~F.col("to.ahead"), F.struct("pos", "size", "row")))).alias("rows"), F.array_sort(F.collect_list(F.when(F.col("to.ahead"), F.struct("pos", "size")))).alias("follow"))
    sizes = F.concat("rows.size", "follow.size")
    cut = cut.select("key", "slice", F.transform("rows", lambda x: x["row"]).alias("rows"), F.size("rows").alias("n"), sizes.alias("sizes"))
    cut = written(cut.withColumn("next", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i + _taken(i, most_items, most_size))), "chunk-slices")
    # of each row that may begin the slice's first chunk: the row of the next slice that begins one, and the chunks begun here
    none = F.array().cast("array<struct<exit:int,begun:bigint>>")

    def step(last: Column, i: Column) -> Column:
        to = F.get("next", i)
        after = F.get(last, to - i - 1)
        new = F.when(to >= F.col("n"), F.struct((to - F.col("n")).alias("exit"), F.lit(1).cast("long").alias("begun"))).otherwise(F.struct(after["exit"].alias("exit"), (after["begun"] + 1).alias("begun")))
        return F.slice(F.concat(F.array(new), last), 1, most_items)

    beyond = F.transform(F.sequence(F.lit(0), F.lit(most_items - 1)), lambda e: F.struct((e - F.col("n")).alias("exit"), F.lit(0).cast("long").alias("begun")))
    ways = cut.select("key", "slice", F.concat(F.aggregate(F.reverse(F.sequence(F.lit(0), F.col("n") - 1)), none, step), F.slice(beyond, F.least(F.col("n"), F.lit(most_items)) + 1, most_items)).alias("ways"))
    ways = written(ways, "chunk-ways")
    reach, most = 1, ways.agg(F.max("slice")).first()[0] or 0
    while reach <= most:
        earlier = ways.select("key", (F.col("slice") + reach).alias("slice"), F.col("ways").alias("earlier"))
        both = F.transform("earlier", lambda f: F.struct(F.get("ways", f["exit"])["exit"].alias("exit"), (f["begun"] + F.get("ways", f["exit"])["begun"]).alias("begun")))
        ways = ways.alias("w").join(earlier.alias("e"), F.expr("w.key <=> e.key AND w.slice = e.slice"), "left").select("w.key", "w.slice", F.when(F.col("earlier").isNull(), F.col("ways")).otherwise(both).alias("ways"))
        ways, reach = written(ways, "chunk-ways"), reach * 2
    entries = ways.select("key", (F.col("slice") + 1).alias("slice"), F.get("ways", F.lit(0)).alias("at"))
    cut = cut.alias("c").join(entries.alias("e"), F.expr("c.key <=> e.key AND c.slice = e.slice"), "left").select("rows", "n", "next", F.coalesce("at.exit", F.lit(0)).alias("entry"), F.coalesce("at.begun", F.lit(0)).alias("begun"))
    walk = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.struct(F.col("entry").alias("at"), F.array().cast("array<int>").alias("starts")), lambda acc, _: F.when(acc["at"] < F.col("n"), F.struct(F.get("next", acc["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))).otherwise(acc))
    cut = cut.withColumn("starts", walk["starts"])
    filled = F.transform("starts", lambda s, j: F.array_repeat(F.col("begun") + j, F.least(F.get("next", s), F.col("n")) - s))
    numbers = F.flatten(F.concat(F.array(F.array_repeat(F.col("begun") - 1, F.least("entry", "n"))), filled))
    return cut.select(F.inline(F.arrays_zip(F.col("rows").alias("row"), numbers.alias("chunk")))).select("row.*", "chunk")


def _taken(i: Column, most_items: int, most_size: int) -> Column:
    """How many items a chunk holds that begins with the i-th of sizes."""
    start = F.struct(F.get("sizes", i).alias("total"), F.lit(1).alias("n"), F.lit(True).alias("open"))
    more = lambda acc, s: F.when(acc["open"] & (acc["total"] + s <= most_size), F.struct((acc["total"] + s).alias("total"), (acc["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(acc["total"].alias("total"), acc["n"].alias("n"), F.lit(False).alias("open")))
    return F.aggregate(F.slice("sizes", i + 2, F.lit(most_items - 1)), start, more)["n"]
