"""State in buckets: merges read and rewrite only the buckets that a change falls into, and never shuffle the state.

A table is partitioned by part, the hash of its key modulo `parts`, and bucketed by its key into a multiple of that number, so
a bucket lies in one part. A merge deals its changes by the same hash and joins them to the buckets where they lie; what
is rewritten replaces the touched parts by dynamic partition overwrite, and other parts keep their files. A change that
changes nothing (all values equal, nulls as well) touches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.commits import file_system
from millrace.session import written


@dataclass
class Bucketed:
    """name: in the catalog; path: where its files are."""

    name: str
    path: str
    key: str
    parts: int = 16
    buckets: int = 64

    def part(self) -> Column:
        return F.pmod(F.hash(self.key), F.lit(self.parts))

    def create(self, rows: DataFrame) -> None:
        """A new table of rows, whose keys are distinct and not null."""
        if self.buckets % self.parts:
            raise ValueError("buckets must be a multiple of parts")
        dealt = rows.repartition(self.buckets, self.key).withColumn("part", self.part())
        dealt.write.format("parquet").partitionBy("part").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name)

    def rows(self, spark: SparkSession, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        found = spark.table(self.name)
        return (found if parts is None else found.where(F.col("part").isin(parts))).drop("part")


def joined(table: Bucketed, changes: DataFrame, parts: list[int]) -> DataFrame:
    """The rows of some parts as they will be, each with changed: whether it differs from what is there.

    changes(key, delete boolean, values of the table): one row for each key. Full outer on the key, so rows without a change,
    changes without a row and deletions come out of one pass; rows that go are left with gone.
    """
    spark, key = changes.sparkSession, table.key
    old = table.rows(spark, parts)
    values = [c for c in old.columns if c != key]
    new = changes.where(table.part().isin(parts)).repartition(table.buckets, key).select(F.col(key), F.col("delete").alias("__delete"), F.struct(*values).alias("__new"))
    both = old.select(key, F.struct(*values).alias("__old")).hint("merge").join(new, key, "full_outer")
    there, asked = F.col("__old").isNotNull(), F.col("__delete").isNotNull()
    gone = asked & F.col("__delete")
    changed = asked & F.when(gone, there).otherwise(~there | ~F.col("__old").eqNullSafe(F.col("__new")))
    return both.select(key, *(F.when(asked & ~gone, F.col(f"__new.{v}")).otherwise(F.col(f"__old.{v}")).alias(v) for v in values), F.coalesce(gone, F.lit(False)).alias("gone"), F.coalesce(changed, F.lit(False)).alias("changed"))


def merge(table: Bucketed, changes: DataFrame) -> list[int]:
    """Apply changes and return the parts that were rewritten. The changes are written first, as they are read twice; of
    a key that repeats, the merge fails rather than to guess."""
    spark = changes.sparkSession
    changes = written(changes.withColumn("delete", F.coalesce("delete", F.lit(False))), "bucket-changes")
    twice = changes.groupBy(table.key).count().where("count > 1").limit(1).collect()
    if twice or changes.where(F.col(table.key).isNull()).limit(1).collect():
        raise ValueError("a change needs a key, and a key has one change")
    near = [r["part"] for r in changes.select(table.part().alias("part")).distinct().collect()]
    if not near:
        return []
    touched = sorted(r["part"] for r in joined(table, changes, near).where("changed").select(table.part().alias("part")).distinct().collect())
    if not touched:
        return []
    rows = joined(table, changes, touched).where("not gone").drop("gone", "changed").withColumn("part", table.part())
    emptied = set(touched) - {r["part"] for r in rows.select("part").distinct().collect()}
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.select(spark.table(table.name).columns).write.insertInto(table.name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    for part in sorted(emptied):  # nothing is written for a part without rows, so nothing replaces it
        spark.sql(f"ALTER TABLE {table.name} DROP IF EXISTS PARTITION (part = {part})")
        fs, folder = file_system(spark, f"{table.path}/part={part}")
        fs.delete(folder, True)
    spark.catalog.refreshTable(table.name)
    return touched
