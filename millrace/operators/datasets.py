"""Typed state, datasets and keyed reads, versioned documents, runs, ledgers and stored objects as tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def typed_state(rows: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]], position: str = "position") -> DataFrame:
    """State rows with each child table as a list of structs in the order of its position; empty where it has none.

    children: name -> (table with the key and the position, its columns). Each child is grouped by itself, so lists
    never multiply each other.
    """
    out = rows
    for name, (table, columns) in children.items():
        listed = F.transform(F.array_sort(F.collect_list(F.struct(position, *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
        out = out.join(table.groupBy(key).agg(listed.alias(name)), key, "left")
        element = table.select(*columns).schema
        out = out.withColumn(name, F.coalesce(name, F.array().cast(f"array<{element.simpleString()}>")))
    return out


def lookup(rows: DataFrame, key: str, ids: Iterable | DataFrame) -> DataFrame:
    """Rows with one of the ids: a list of literals reaches the scan as a filter, a table is a semi join."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    return rows.where(F.col(key).isin(list(ids)))


def review_subset(state: DataFrame, ids: DataFrame, urls: DataFrame, statuses: Iterable[str], url_list: str = "urls") -> DataFrame:
    """State rows(id, status, urls, ...) that a review needs: with one of the ids or urls, or in one of the statuses.

    Each way is a semi join or filter of its own; their ids are united, as an OR would compare every pair.
    """
    by_url = state.select("id", F.explode(url_list).alias("url")).join(urls.select("url"), "url", "left_semi").select("id")
    found = state.join(ids.select("id"), "id", "left_semi").select("id").union(by_url).union(state.where(F.col("status").isin(*statuses)).select("id"))
    return state.join(found.distinct(), "id", "left_semi")


def read_dataset(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """Documents of one dataset out of rows(dataset, position, payload), typed, in their order. dataset is a partition or
    a pushed filter."""
    mine = rows.where(F.col("dataset") == name)
    return mine.select("position", F.from_json("payload", schema).alias("d")).orderBy("position").select("position", "d.*")


def current_version(documents: DataFrame, version: int, default: Column) -> DataFrame:
    """Payloads of documents(key, payload) of the version that is read; the default for others and for what is no JSON."""
    found = F.get_json_object("payload", "$.version").try_cast("int")
    return documents.withColumn("payload", F.when(found.eqNullSafe(F.lit(version)), F.col("payload")).otherwise(default))


def event_lines(rows: DataFrame, event: str, run_id: Column, level: Column, at: Column, fields: dict[str, Column]) -> DataFrame:
    """(line): a JSON line for each row, with timestamp, run, event and level before the given fields; nulls are left out."""
    head = (F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), run_id.alias("run_id"), F.lit(event).alias("event"), level.alias("level"))
    return rows.select(F.to_json(F.struct(*head, *[c.alias(name) for name, c in fields.items()])).alias("line"))


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, runner, started_at, finished_at, outcome) out of the appended events(run_id, runner, at, outcome), where a
    start has the outcome running: a run that has not ended when a later one of its runner starts was abandoned, and
    counts as failed from then on."""
    one = events.groupBy("run_id").agg(F.min_by("runner", "at").alias("runner"), F.min("at").alias("started_at"), F.max(F.when(F.col("outcome") != "running", F.struct("at", "outcome"))).alias("end"))
    after = F.lead("started_at").over(Window.partitionBy("runner").orderBy("started_at", "run_id"))
    one = one.withColumn("__next", after)
    lost = F.col("end").isNull() & F.col("__next").isNotNull()
    return one.select("run_id", "runner", "started_at", F.coalesce("end.at", F.when(lost, F.col("__next"))).alias("finished_at"), F.coalesce("end.outcome", F.when(lost, F.lit("failed")), F.lit("running")).alias("outcome"))


def latest_upserts(rows: DataFrame, keys: list[str], at: str, tie: list[str]) -> DataFrame:
    """The row that was written last for each key; upserts are appends, and readers take the newest."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), *[F.desc(t) for t in tie])
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def append_ledger(path: str, calls: DataFrame) -> None:
    """Append model calls; a ledger is never rewritten."""
    calls.write.mode("append").parquet(path)


def stored_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified) of the files under a folder, by listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def store_documents(stored: DataFrame, documents: DataFrame, overwrite: bool = False) -> DataFrame:
    """documents(key, content binary) against stored(key, sha256): with sha256 and action: new, same (nothing to write),
    replaced, or conflict (another content under the key, which only `overwrite` replaces)."""
    d = documents.withColumn("sha256", F.sha2("content", 256))
    j = d.join(stored.select("key", F.col("sha256").alias("__old")), "key", "left")
    action = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("sha256"), "same").when(F.lit(overwrite), "replaced").otherwise("conflict")
    return j.withColumn("action", action).drop("__old")


def key_rows(state: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(kind, key, ids): an index of state rows by several kinds of key, each a column or a list, as a multimap; ids in
    order. Empty keys are left out."""
    out = None
    for kind, column in keys.items():
        part = state.select(F.lit(kind).alias("kind"), F.explode(column).alias("key"), "id").where("key is not null and key <> ''")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "key").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def any_rows(*parts: DataFrame) -> DataFrame:
    """One row: whether any of the parts has a row. One row of each is enough."""
    out = None
    for p in parts:
        one = p.limit(1).select(F.lit(1).alias("x"))
        out = one if out is None else out.unionAll(one)
    return out.agg((F.count("*") > 0).alias("found"))


def typed_rows(documents: DataFrame, payload: str, schema: StructType, defaults: dict[str, Column], dropped: Iterable[str] = ()) -> DataFrame:
    """JSON documents as typed rows: missing values take their defaults, fields of the run alone are dropped, and what is no
    JSON goes."""
    whole = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = documents.withColumn("__d", F.from_json(payload, whole, {"columnNameOfCorruptRecord": "_corrupt"})).where("__d is not null and __d._corrupt is null")
    names = [f.name for f in schema.fields if f.name not in set(dropped)]
    kept = [c for c in documents.columns if c != payload]
    return parsed.select(*kept, *[F.coalesce(F.col(f"__d.{n}"), defaults[n]).alias(n) if n in defaults else F.col(f"__d.{n}").alias(n) for n in names])


def publish_snapshot(df: DataFrame, path: str) -> None:
    """Replace what readers see by df as a whole: a new version is written first, then a row that names it; a reader sees
    the old version or the new one, and a run that breaks off leaves the old."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    named = df.sparkSession.range(1).select(F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("at"))
    named.coalesce(1).write.mode("append").parquet(f"{path}/published")


def read_snapshot(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """The newest published version; the default where nothing has been published."""
    from pyspark.errors import AnalysisException

    try:
        newest = spark.read.parquet(f"{path}/published").agg(F.max_by("version", F.struct("at", "version")).alias("v")).first()["v"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return default
    return spark.read.parquet(f"{path}/versions/{newest}")
