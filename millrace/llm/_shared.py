"""What the operators share: folders that all executors see, and tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path, never used before, in the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def place(names: list[str], name: str) -> int:
    """Where a column stands: the one of exactly that name, else the first that differs by case alone."""
    if name in names:
        return names.index(name)
    return [n.lower() for n in names].index(name.lower())


def pick(docs: DataFrame, **names: str) -> DataFrame:
    """Columns of docs under new names; others, whatever they are called, are not read."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.select(*(F.col(f"c{place(docs.columns, name)}").alias(alias) for alias, name in names.items()))


def carried(docs: DataFrame) -> tuple[DataFrame, Callable[[str], Column], Callable[..., DataFrame]]:
    """Rows of docs as one column `row`, so that none of their names clashes with another; how to refer to a column of
    docs; and how to give rows back, with changed columns by name and with further ones."""
    names = docs.columns
    fields = [f"c{k}" for k in range(len(names))]
    rows = docs.toDF(*fields).select(F.struct(*fields).alias("row"))

    def at(name: str) -> Column:
        return F.col(f"row.c{place(names, name)}")

    def back(df: DataFrame, changed: dict[str, Column] | None = None, *more: str) -> DataFrame:
        own = {place(names, name): column for name, column in (changed or {}).items()}
        kept = [k for k, name in enumerate(names) if name not in more]
        return df.select(*(own.get(k, F.col(f"row.c{k}")).alias(f"c{k}") for k in kept), *more).toDF(*(names[k] for k in kept), *more)

    return rows, at, back


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
