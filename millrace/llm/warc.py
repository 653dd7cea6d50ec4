"""WARC archives: a PySpark Python data source that writes and reads them, and revisit records.

Reading plans partitions of whole files packed by size, takes filters on the record's type and header fields,
and parses headers first. The payload of a record that a filter rejects, or of any record where the schema
asked for has no payload, is neither inflated nor decoded: plain files are read past it, and gzip members that
carry their compressed length in the `sl` extra field (this writer's do) are skipped as a whole; a member
without it has to be inflated to find its end, but what comes out is thrown away.

Writing leaves each task's files under a temporary name and moves those of committed tasks into place, so a
task that is lost or runs twice leaves nothing that a reader sees.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.llm._shared import materialize, pick

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, content_type string, page_id string, refers_to string, payload_digest string, payload_length string, payload binary, path string, offset long"
#: Column -> header it is read from and written to.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type", "page_id": "X-Page-ID", "refers_to": "X-Refers-To-Page-ID", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
_STEP = 1 << 18
_BATCH_BYTES = 8 << 20


def payload_digest(payload: bytes) -> str:
    """Base32 of SHA-1, in capitals."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: Sequence[tuple[str, str]], payload: bytes) -> bytes:
    """One WARC/1.1 record. Line breaks in a header's value become spaces."""
    lines = [b"WARC/1.1"] + [f"{k}: {' '.join(v.splitlines())}".encode("utf-8", "surrogatepass") for k, v in [*fields, ("Content-Length", str(len(payload)))]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member that tells its whole compressed length and its content's length in the extra field `sl`."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _filesystem(path: str):
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


class _Stream:
    """Bytes of a file, ahead of which one may look."""

    def __init__(self, file):
        self.file, self.kept, self.at, self.base = file, b"", 0, 0

    @property
    def place(self) -> int:
        return self.base + self.at

    def peek(self, n: int) -> bytes:
        while len(self.kept) - self.at < n:
            more = self.file.read(max(_STEP, n))
            if not more:
                break
            self.base += self.at
            self.kept, self.at = self.kept[self.at :] + more, 0
        return self.kept[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        inside = min(n, len(self.kept) - self.at)
        self.at += inside
        if n > inside:
            self.base += self.at + n - inside
            self.kept, self.at = b"", 0
            self.file.seek(self.base)

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the file."""
        n = 1024
        while True:
            ahead = self.peek(n)
            k = ahead.find(mark)
            if k >= 0:
                return self.take(k + len(mark))
            if len(ahead) < n:
                if ahead.strip():
                    raise ValueError(f"a record breaks off at {self.place}")
                return None
            n *= 2


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by their names in lower case; lines that go on are joined."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "surrogatepass")
        elif b":" in line:
            name, value = line.split(b":", 1)
            last = name.strip().decode("utf-8", "replace").lower()
            out[last] = value.strip().decode("utf-8", "surrogatepass")
    return out


def records(file, wanted, with_payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(offset, header fields, payload) of the records that wanted(fields) accepts, plain or gzip by their bytes."""
    stream = _Stream(file)
    while True:
        while stream.peek(2) == b"\r\n":
            stream.skip(2)
        start = stream.place
        lead = stream.peek(24)
        if not lead:
            return
        if lead[:2] != b"\x1f\x8b":
            head = stream.until(b"\r\n\r\n")
            if head is None:
                return
            fields = parse_head(head)
            length = int(fields.get("content-length", 0))
            if wanted(fields):
                yield start, fields, stream.take(length) if with_payload else None
                if not with_payload:
                    stream.skip(length)
            else:
                stream.skip(length)
            continue
        size = struct.unpack("<I", lead[16:20])[0] if lead[3] & 4 and lead[12:14] == b"sl" else 0
        z, out = zlib.decompressobj(31), b""
        used = 0
        while b"\r\n\r\n" not in out and not z.eof:
            piece = stream.peek(used + 2048)[used:] if size else stream.take(2048)
            if not piece:
                raise ValueError(f"a record breaks off at {start}")
            used += len(piece)
            out += z.decompress(piece)
        cut = out.find(b"\r\n\r\n") + 4
        if cut < 4:
            raise ValueError(f"no header ends in the record at {start}")
        fields = parse_head(out[:cut])
        keep = wanted(fields)
        need = keep and with_payload
        if size and not need:
            stream.skip(size)
        elif size:
            rest = stream.take(size)
            out += z.decompress(rest[used:])
        else:
            parts = [out]
            while not z.eof:
                piece = stream.take(_STEP)
                if not piece:
                    raise ValueError(f"a record breaks off at {start}")
                more = z.decompress(piece)
                parts += [more] if need else []
            stream.at -= len(z.unused_data)
            out = b"".join(parts)
        if keep:
            yield start, fields, out[cut : cut + int(fields.get("content-length", 0))] if need else None


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path, self.tests = schema.names, options["path"], []
        self.verify = str(options.get("verify", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership, prefix and not-null tests of header columns; the rest stays with Spark."""
        for f in filters:
            header = HEADERS.get(f.attribute[0], "").lower() if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 else ""
            if not header:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((header, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((header, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((header, "starts", f.value))
            else:
                self.tests.append((header, "there", None))

    def wanted(self, fields: dict[str, str]) -> bool:
        for header, kind, value in self.tests:
            own = fields.get(header)
            if own is None or kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        fs, inner = _filesystem(self.path)
        info = fs.get_file_info(inner)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=False))
        files = sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path)
        out: list[InputPartition] = []
        own: list[str] = []
        size = 0
        for f in files:
            if own and size + f.size > self.partition_bytes:
                out.append(_Files(tuple(own)))
                own, size = [], 0
            own.append(f.path)
            size += f.size
        return [*out, _Files(tuple(own))]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        schema = pa.schema([(c, {"payload": pa.binary(), "offset": pa.int64()}.get(c, pa.string())) for c in self.columns])
        rows: list[list] = []
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for offset, fields, payload in records(file, self.wanted, "payload" in self.columns):
                    if payload is not None and self.verify and fields.get("warc-type") != "revisit" and (named := fields.get("warc-payload-digest", "")).startswith("sha1:"):
                        if payload_digest(payload) != named[5:]:
                            raise ValueError(f"the payload at {offset} of {path} does not have the digest in its header")
                    special = {"payload": payload, "path": path, "offset": offset}
                    rows.append([special[c] if c in special else fields.get(HEADERS[c].lower()) for c in self.columns])
                    held += len(payload or b"") + 500
                    if held > _BATCH_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"].rstrip("/")
        self.compress = str(options.get("compression", "gzip")).lower() == "gzip"
        self.most_bytes = int(options.get("filebytes", options.get("fileBytes", 1 << 30)))
        self.attempt = uuid.uuid4().hex
        self.date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, inner = _filesystem(self.path)
        tmp = f"{inner}/_writing-{self.attempt}"
        fs.create_dir(tmp, recursive=True)
        pack = gzip_member if self.compress else bytes
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in self.columns)):
                if out is None or size >= self.most_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"records-{uuid.uuid4().hex}.warc{'.gz' * self.compress}")
                    out = fs.open_output_stream(f"{tmp}/{names[-1]}", compression=None)
                    first = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"software: millrace\r\nformat: WARC File Format 1.1\r\n")
                    size = out.write(pack(first))
                own = dict(zip(self.columns, row))
                payload = own.pop("payload", None) or b""
                fields = [(HEADERS[c], str(v)) for c, v in own.items() if v is not None and c in HEADERS]
                fields += [("WARC-Date", self.date)] if own.get("warc_date") is None else []
                fields += [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")] if own.get("record_id") is None else []
                fields += [("WARC-Profile", PROFILE)] if own.get("record_type") == "revisit" else []
                size += out.write(pack(record(fields, payload)))
        if out is not None:
            out.close()
        return _Written(tuple(names))

    def commit(self, messages: list[_Written | None]) -> None:
        fs, inner = _filesystem(self.path)
        for message in messages:
            for name in message.names if message else ():
                fs.move(f"{inner}/_writing-{self.attempt}/{name}", f"{inner}/{name}")
        self._clear(fs, inner)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_filesystem(self.path))

    def _clear(self, fs, inner: str) -> None:
        if fs.get_file_info(f"{inner}/_writing-{self.attempt}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{inner}/_writing-{self.attempt}")


class WarcSource(DataSource):
    """format("warc"). Reading: .schema() may name any of the columns of SCHEMA; options partitionBytes and
    verify (payload digests; default true). Writing: options compression (gzip or none) and fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, salts: int = 32) -> DataFrame:
    """Records for pages, a row each, to be written with format("warc").

    Of the rows with one payload of least_bytes or more, that with the largest id is a response and the others
    are revisits of it, without payload; rows that share that id are responses both. Smaller payloads are all
    responses. A null html is an empty payload; a null id is smaller than any other and refers where another
    id is there; a null url leaves its header out.

    Only (digest, id) is aggregated to find the responses. Payloads are shuffled once, to meet the digests
    that occur more than once; that join is salted, so a payload that a third of all pages share is spread
    over `salts` keys.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pick(pages, id=id_col, target_uri=url_col, html=html_col).select(F.col("id").cast("long"), "target_uri", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.max("id").alias("lead")).where("n > 1 and lead is not null")
    groups = materialize(groups.select("sha1", "lead", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), "warc-groups")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "target_uri"), F.lit(salts)).cast("int"))
    joined = salted.join(groups, ["sha1", "salt"], "left")
    revisit = F.col("lead").isNotNull() & ~F.col("id").eqNullSafe(F.col("lead"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.col("id").cast("string").alias("page_id"),
        F.when(revisit, F.col("lead").cast("string")).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32("sha1")).alias("payload_digest"),
        F.octet_length("payload").cast("string").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(hex_col: str):
    """Base32 of 20 bytes given in hexadecimal."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_col, k, 5), 16, 2), 20, "0") for k in range(1, 41, 5)])
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(letters, F.conv(F.substring(bits, k, 5), 2, 10).cast("int") + 1, 1) for k in range(1, 161, 5)])


def write_archives(pages: DataFrame, folder: str, compression: str = "gzip", file_bytes: int = 64 << 20, **options) -> None:
    """Write pages as archives in folder; see with_revisits. An empty table writes no archive."""
    register(pages.sparkSession)
    with_revisits(pages, **options).write.format("warc").option("compression", compression).option("fileBytes", file_bytes).mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to) of the responses and revisits
    in folder. A response's payload is measured and checked against its digest as it is read; a revisit has what
    its header says of the full payload."""
    register(spark)
    rows = spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit"))
    stored = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("payload_length").cast("long"))
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "target_uri", stored.cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP4_SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
groups AS (SELECT hex, max(page_id) AS lead FROM rows GROUP BY hex),
bits AS (SELECT r.page_id, g.lead, strlen(r.payload)::BIGINT AS payload_bytes,
                list_transform(range(0, 8), lambda k: ('0x' || substr(r.hex, (k * 5 + 1)::INT, 5))::BIGINT) AS parts
         FROM rows r JOIN groups g USING (hex))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((parts[(j // 4 + 1)::INT] >> (15 - 5 * (j % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM bits
"""
