"""Stateful walks as a stream: each walk follows the pages of one session from cursor to cursor.

A walk is a folder of pages, laid out as Spark writes text partitioned by walk and bucket: walk=<name>/bucket=<number>/, the
CRC-32 of a page's cursor modulo BUCKETS, so folders and files don't grow in number with the pages. A line holds
{"page": cursor, "body": the page as text}. A page holds {"records": [...], "next": the cursor of the page that follows, or false, "token": what names the session}.
An offset holds, for each walk, the cursor to read next, the session's token, how many pages and records were taken,
how many pages in a row were old, and why it ended; so a query that is stopped goes on from its checkpoint where it was,
within the session it was in.

Which page follows stands in the page, so the reader walks on the driver, pagesPerBatch pages of each walk for a batch;
records are read by the executors, a task for each walk. A walk ends at a page without records or without next, after
maxPages pages, after two old pages in a row if a frontier is given (all records of a page published before that day),
when a page can't be read, and when a page belongs to another session; the last three but the frontier are
failures, reported as one row with an error.

After a restart Spark asks for the partitions of the last batch before it asks for new offsets, which tells the reader
where it stands; the trigger availableNow asks in another order, so run_walks uses the default trigger and stops
when nothing is left.
"""

from __future__ import annotations

import io
import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "walk string, page string, ord long, payload string, error string"
OLD_PAGES = 2
BUCKETS = 64


@dataclass
class _Stretch(InputPartition):
    walk: str
    pages: list[tuple[str, int]]  # cursor, number of its first record
    error: str


def _fresh(start: str) -> dict:
    return {"next": start, "token": "", "pages": 0, "taken": 0, "old": 0, "end": ""}


class WalkReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = options.get("start", "0")
        self.most_pages = int(options.get("maxpages", options.get("maxPages", 1000)))
        self.at_once = int(options.get("pagesperbatch", options.get("pagesPerBatch", 20)))
        self.frontier, self.day = options.get("frontier", ""), options.get("day", "published")
        self.position: dict | None = None

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def _page(self, walk: str, cursor: str) -> dict:
        fs, inner = self._fs()
        found = fs.get_file_info(pafs.FileSelector(f"{inner}/walk={walk}/bucket={zlib.crc32(cursor.encode()) % BUCKETS}"))
        parts = sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
        page = json.loads(self._body(fs, parts, cursor))
        if not isinstance(page, dict):
            raise ValueError("a page is an object")
        return page

    @staticmethod
    def _body(fs, parts: list[str], cursor: str) -> str:
        """A page's text; lines of a bucket are read until it comes."""
        for path in parts:
            with io.TextIOWrapper(fs.open_input_file(path), encoding="utf-8", newline="\n") as lines:
                for line in lines:
                    if (one := json.loads(line))["page"] == cursor:
                        return one.get("body", "")
        raise FileNotFoundError(f"no page {cursor}")

    def initialOffset(self) -> dict:
        fs, inner = self._fs()
        found = [f.base_name for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.Directory]
        return {name.removeprefix("walk="): _fresh(self.start) for name in sorted(found) if name.startswith("walk=")}

    def _step(self, walk: str, at: dict) -> dict:
        """One page further."""
        try:
            page = self._page(walk, at["next"])
            records = page.get("records") or []
            days = [str(r[self.day]) for r in records if isinstance(r, dict) and r.get(self.day)]
        except (OSError, ValueError) as error:
            return at | {"end": type(error).__name__}
        token = str(page.get("token") or "")
        if at["token"] and token and token != at["token"]:
            return at | {"end": "another session"}
        old = at["old"] + 1 if self.frontier and days and max(days) < self.frontier else 0
        follows = page.get("next")
        on = at | {"token": at["token"] or token, "pages": at["pages"] + 1, "taken": at["taken"] + len(records), "old": old}
        if not records or follows in (None, False, ""):
            return on | {"next": "", "end": "end"}
        if old >= OLD_PAGES:
            return on | {"next": "", "end": "frontier"}
        if on["pages"] >= self.most_pages:
            return on | {"next": str(follows), "end": "page limit"}
        return on | {"next": str(follows)}

    def latestOffset(self) -> dict:
        at = dict(self.position if self.position is not None else self.initialOffset())
        for walk in at:
            for _ in range(self.at_once):
                if at[walk]["end"]:
                    break
                at[walk] = self._step(walk, at[walk])
        self.position = at
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.position is None:
            self.position = end
        out: list[InputPartition] = []
        for walk, goal in end.items():
            at, pages = start.get(walk) or _fresh(self.start), []
            while at["pages"] < goal["pages"] and not at["end"]:
                pages.append((at["next"], at["taken"]))
                at = self._step(walk, at)
            failed = goal["end"] if goal["end"] not in ("", "end", "frontier") and not (start.get(walk) or {}).get("end") else ""
            if pages or failed:
                out.append(_Stretch(walk, pages, failed))
        return out

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        for cursor, first in partition.pages:
            for k, record in enumerate(self._page(partition.walk, cursor).get("records") or []):
                yield partition.walk, cursor, first + k, json.dumps(record, sort_keys=True, ensure_ascii=False), None
        if partition.error:
            yield partition.walk, None, None, None, partition.error


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "walks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> WalkReader:
        return WalkReader(self.options)


def write_pages(pages: DataFrame, path: str) -> None:
    """pages(walk, page, body): a folder of walks; a body is one line of JSON."""
    bucket = (F.crc32(F.col("page").cast("string").cast("binary")) % BUCKETS).alias("bucket")
    line = F.to_json(F.struct(F.col("page").cast("string").alias("page"), "body")).alias("value")
    pages.select("walk", bucket, line).repartition("walk", "bucket").write.partitionBy("walk", "bucket").text(path)


def read_walks(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream of all walks in a folder. Options: start, maxPages, pagesPerBatch, frontier and day, see above."""
    spark.dataSource.register(WalkSource)
    stream = spark.readStream.format("walks")
    for name, value in options.items():
        stream = stream.option(name, value)
    return stream.load(path)


def run_walks(stream: DataFrame, out: str, checkpoint: str, batches: int | None = None) -> DataFrame:
    """Walk until nothing is left, or until so many batches are done; the file sink takes each batch once. Another call with
    the same folders goes on from there."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        if batches is None:
            q.processAllAvailable()
        else:
            done = 0
            while q.isActive and done < batches:
                time.sleep(0.05)
                done = len({p["batchId"] for p in q.recentProgress if p["numInputRows"]})
    finally:
        q.stop()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
