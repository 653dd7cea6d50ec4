"""A Python data source for segmented, paged JSON: one partition for each segment, failures as rows.

A segment is a folder of pages (0.json, 1.json, ...); a page holds {"records": [...], "total": n or null, "next":
bool or the name of the page that follows (a cursor), "status": an HTTP code or none}. Paging stops at the first page that says so: an empty one, next false, or when
total is reached. A page that can't be read, one with an error status, and a segment that is not at its end after
maxPages pages fail their segment from there on; what the segment gave before stays. With the option inOrder the
segments are read one after another, as a host that limits its callers asks for, and a 403 or 429 ends them all:
those that follow are reported as aborted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "segment string, ord long, payload string, error string"


@dataclass
class _Segments(InputPartition):
    names: list[str]
    paths: list[str]


def page_is_last(page: dict, taken: int) -> bool:
    records = page.get("records") or []
    total = page.get("total")
    return not records or page.get("next") is False or isinstance(total, int) and taken >= total


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most_pages = int(options.get("maxpages", options.get("maxPages", 40)))
        self.in_order = str(options.get("inorder", options.get("inOrder", "false"))).lower() == "true"

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        fs, inner = self._fs()
        found = fs.get_file_info(pafs.FileSelector(inner))
        folders = [f for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.Directory]
        if self.in_order and folders:
            return [_Segments([f.base_name for f in folders], [f.path for f in folders])]
        return [_Segments([f.base_name], [f.path]) for f in folders]

    def read(self, partition: _Segments) -> Iterator[tuple]:
        blocked = False
        for name, path in zip(partition.names, partition.paths):
            if blocked:
                yield name, None, None, "aborted"
                continue
            for row in self._pages(name, path):
                blocked = blocked or row[3] in ("status 403", "status 429")
                yield row

    def _pages(self, name: str, path: str) -> Iterator[tuple]:
        fs, _ = self._fs()
        taken, cursor = 0, "0"
        for k in range(self.most_pages):
            try:
                with fs.open_input_stream(f"{path}/{cursor}.json") as f:
                    page = json.loads(f.read())
                records = page.get("records") or []
            except (OSError, ValueError, AttributeError) as error:
                yield name, None, None, type(error).__name__
                return
            if int(page.get("status") or 200) >= 400:
                yield name, None, None, f"status {page['status']}"
                return
            for record in records:
                yield name, taken, json.dumps(record, sort_keys=True, ensure_ascii=False), None
                taken += 1
            if page_is_last(page, taken):
                break
            cursor = page["next"] if isinstance(page.get("next"), str) else str(k + 1)
        else:
            yield name, None, None, "page limit"
            return
        if not taken:
            yield name, None, None, None  # a segment without records is still one that was searched


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self.options)


def read_segments(spark: SparkSession, path: str, max_pages: int = 40, in_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, report): the records of all segments, and one row with rows, failed_segments and total_segments."""
    spark.dataSource.register(SegmentSource)
    rows = spark.read.format("segments").option("maxPages", max_pages).option("inOrder", in_order).load(path)
    report = rows.groupBy("segment").agg(F.count("payload").alias("rows"), F.max(F.col("error").isNotNull()).alias("failed")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if("failed").alias("failed_segments"), F.count("*").alias("total_segments"))
    return rows.where("error is null and payload is not null").drop("error"), report


def convert(records: DataFrame, payload: str, ddl: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): records parsed as ddl; a record is bad if it can't be parsed or lacks a required field."""
    parsed = records.withColumn("__r", F.from_json(payload, f"{ddl}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    ok = F.col("__r").isNotNull() & F.col("__r._corrupt").isNull()
    for name in required:
        ok &= F.col(f"__r.{name}").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    names = [c for c in parsed.schema["__r"].dataType.names if c != "_corrupt"]
    keep = [c for c in records.columns if c != payload]
    return parsed.where(ok).select(*keep, *[F.col(f"__r.{n}").alias(n) for n in names]), parsed.where(~ok).drop("__r")
