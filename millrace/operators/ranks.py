"""Row numbers over whole tables, without a task that sees them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

_ROW_BITS = 33  # monotonically_increasing_id: the partition stands above these


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a globally sorted table with their numbers in it, from 1 on.

    Sorting has dealt the rows into ranges, one a partition. They are written with their numbers within their ranges;
    the ranges' counts, a number for each task, are added up on the driver and moved onto the rows. Rows that sort
    alike are numbered as they came. An empty table gives none.
    """
    rows = written(ordered.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", _ROW_BITS)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = accumulate((n for _, n in counts), initial=0)
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "__part long, __start long")
    moved = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return rows.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, moved).drop("__at", "__part", "__start")
