"""Relational building blocks: semi joins over several keys, multiset differences, band and as-of joins, nesting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def semi_any(df: DataFrame, key: str, branches: list[DataFrame]) -> DataFrame:
    """Rows of df whose key is in any of the branches (each with one column). The union keeps each branch's own filter
    pushdown, which an OR over subqueries would lose."""
    keys = reduce(lambda a, b: a.union(b), [b.toDF("__k") for b in branches]).distinct()
    return df.join(keys, F.col(key) == F.col("__k"), "left_semi")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What a has more often than b, with how much more (n). Counted on both sides before the shuffle, where EXCEPT ALL
    would replicate rows; nulls are equal."""
    cols = a.columns
    tagged = a.withColumn("__w", F.lit(1)).unionByName(b.withColumn("__w", F.lit(-1)))
    return tagged.groupBy(*cols).agg(F.sum("__w").alias("__n")).where("__n > 0").withColumnRenamed("__n", "n")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows equally often, and how many differ on each side."""
    tagged = a.withColumn("__w", F.lit(1)).unionByName(b.withColumn("__w", F.lit(-1)))
    n = tagged.groupBy(*a.columns).agg(F.sum("__w").alias("__n"))
    return n.agg(F.coalesce(F.sum(F.greatest("__n", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("__n"), F.lit(0))), F.lit(0)).alias("only_b")).withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def band_join(df: DataFrame, key: str, day: str, width: int, id_col: str) -> DataFrame:
    """Pairs of different rows of a key at most width days apart: df's columns and other_<id>, other_<day>. An equi join
    on the key and a bucket of days (a row looks into its own bucket and the two beside it), so that a key with many
    rows does not meet itself whole."""
    bucket = F.floor(F.date_diff(F.col(day), F.lit("1970-01-01").cast("date")) / max(1, width)).cast("long")
    left = df.withColumn("__b", bucket)
    right = df.select(F.col(key).alias("__k"), F.col(id_col).alias(f"other_{id_col}"), F.col(day).alias(f"other_{day}"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b2"))
    j = left.join(right, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__b2")))
    return j.where((F.abs(F.date_diff(day, f"other_{day}")) <= width) & (F.col(id_col) != F.col(f"other_{id_col}"))).drop("__b", "__b2", "__k")


def asof_counts(events: DataFrame, key: str, at: str, id_col: str, probe: Column, target: Column) -> DataFrame:
    """For each probe row: the last target row strictly before it in its key, and how many there are. One window over a
    range that ends before the row's time, instead of an inequality join."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    marked = events.where(probe | target).withColumn("__t", t).withColumn("__hit", target)
    out = marked.withColumn("last_at", F.max(F.when(F.col("__hit"), F.col(at))).over(w)).withColumn("n", F.count(F.when(F.col("__hit"), 1)).over(w))
    return out.where(probe).select(id_col, "last_at", "n")


def nest(children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """(key, name array<struct<fields>>) sorted by the fields."""
    return children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def unnest_pairs(df: DataFrame, keep: list[str], pairs: dict[str, Column]) -> DataFrame:
    """Lists by place to rows with position; places where all are null go."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in pairs.items()])
    rows = df.select(*keep, F.posexplode(zipped).alias("position", "__x")).select(*keep, "position", *[F.col(f"__x.{n}").alias(n) for n in pairs])
    return rows.where(F.coalesce(*[F.col(n) for n in pairs]).isNotNull())


def lookup_label(df: DataFrame, labels: DataFrame, key: str, label_key: str, label: str) -> DataFrame:
    """df with label: the looked-up one, or the key itself."""
    small = labels.select(F.col(label_key).alias("__k"), F.col(label).alias("label"))
    j = df.join(small, F.col(key) == F.col("__k"), "left").drop("__k")
    return j.withColumn("label", F.coalesce("label", F.col(key).cast("string")))


def outdated_parts(stored: DataFrame, current: DataFrame, id_col: str, parts: list[str]) -> DataFrame:
    """(id, outdated array<string>): which parts' digests differ from the current ones; null and missing count as different
    from a value."""
    s = stored.select(id_col, *[F.col(p).alias(f"s_{p}") for p in parts])
    j = s.join(current.select(id_col, *[F.col(p).alias(f"c_{p}") for p in parts]), id_col)
    return j.select(id_col, F.array_compact(F.array(*[F.when(~F.col(f"s_{p}").eqNullSafe(F.col(f"c_{p}")), F.lit(p)) for p in parts])).alias("outdated"))


def conflicting(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for several values."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")
