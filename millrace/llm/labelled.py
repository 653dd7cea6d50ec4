"""Bounded samples of labelled rows, and the fixed split into rows to learn from and rows held out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample_by_label(rows: DataFrame, label: str, id_col: str, per_label: int, most: int) -> DataFrame:
    """About per_label rows of each label and at most `most` in all, chosen by a hash of the id.

    Labels share `most` evenly, but none gets more than it has or than per_label; what is left over goes to the others,
    so rare labels are filled first. Each label's rows are thinned by its share of its count, and ranked within that
    share, so no label is gathered in one task and the last cut takes from all alike. Label counts come to the driver,
    which gets the labels anyway.
    """
    counts = sorted((r["count"], r[label]) for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect())
    shares, left = [], most
    for k, (n, value) in enumerate(counts):
        share = min(n, per_label, left / (len(counts) - k))
        left -= share
        shares.append((value, n / share if share else math.inf))
    if not shares:
        return rows.limit(0)
    thinning = rows.sparkSession.createDataFrame(shares, T.StructType([rows.schema[label], T.StructField("__thinning", T.DoubleType())]))
    u = (F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    ranked = rows.join(F.broadcast(thinning), label).withColumn("__rank", u * F.col("__thinning")).where("__rank < 1.25")
    return ranked.orderBy("__rank", id_col).limit(most).drop("__rank", "__thinning")
