"""Byte-level BPE encoding and decoding, by overlapping chunks.

Texts are split into pre-tokens by a pattern and each pre-token is merged by ranks. A long text is cut into chunks that
overlap, so that one text is the work of many tasks. Every chunk is pre-tokenised from its own start, which may lie within
a pre-token. Two neighbours agree from the first boundary in their overlap on that both have, as what the pattern
matches from a place on depends on the text from there on alone; the first chunk starts right, so by induction each chunk
is right from there on. The pieces between these places are encoded apart. Where two neighbours have no boundary in
common, as in a pre-token that is longer than the overlap, the text is pre-tokenised in one go from the last certain place
on. Decoding looks up the bytes of each id and joins them.

Letters and numbers are those of the library that the ranks are for: its tables of Unicode may be of another version than
those of the pattern module, so both are compared over all characters, and texts with a character that they class
differently are matched by the library's classes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import materialize, pick

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Characters before the end of a chunk where a boundary isn't certain, as a longer match could need more text.
MARGIN = 16
_MEMO_ENTRIES, _MEMO_CHARS, _BYTES_AT_ONCE = 300_000, 64, 1 << 22


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def _classes() -> tuple[dict[str, str], frozenset[str]]:
    """The library's letters and numbers as sets of the pattern module, and the characters that the two class differently."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    single = {bytes([b]): b for b in range(256)}
    sets, odd = {}, set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
        own = sorted(map(ord, set(bytes(probe.encode_ordinary(every)).decode())))
        odd |= set(map(chr, own)) ^ set(regex.findall(name, every))
        starts = [c for k, c in enumerate(own) if not k or own[k - 1] != c - 1]
        ends = [c for k, c in enumerate(own) if k + 1 == len(own) or own[k + 1] != c + 1]
        sets[name] = "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, ends)) + "]"
    return sets, frozenset(odd)


class Encoder:
    """pattern: may use \\p{L}, \\p{N} and \\s, but nothing that looks back; a match must not depend on more than MARGIN
    characters beyond its end."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.pattern, self.plain, self.exact = pattern, regex.compile(pattern, regex.V1), None
        self.memo: dict[str, bytes] = {}

    def matches(self, text: str) -> list[str]:
        """All matches, one after another; characters that none covers are dropped, as the library does."""
        if text.isascii():
            return self.plain.findall(text)
        sets, odd = _classes()
        if odd.isdisjoint(text):
            return self.plain.findall(text)
        if self.exact is None:
            pattern = self.pattern
            for name, own in sets.items():
                pattern = pattern.replace(name, own)
            self.exact = regex.compile(pattern, regex.V1)
        return self.exact.findall(text)

    def boundaries(self, text: str) -> np.ndarray:
        """Ends of matches. Only for patterns whose matches cover the text."""
        return np.cumsum(np.fromiter(map(len, self.matches(text)), np.int64))

    def _ids(self, match: str) -> bytes:
        ids = np.array(self.library._encode_single_piece(match), "<u4").tobytes()
        if len(match) <= _MEMO_CHARS:
            if len(self.memo) >= _MEMO_ENTRIES:
                self.memo.clear()
            self.memo[match] = ids
        return ids

    def encode(self, matches: list[str]) -> bytes:
        """Ids of matches, each encoded by itself, as little-endian unsigned 32-bit integers."""
        known = self.memo.get
        return b"".join([known(m) or self._ids(m) for m in matches])


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@cache
def _token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decode_ids(ids: bytes, path: str) -> bytes:
    table = _token_bytes(path)
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _in_turn(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about _BYTES_AT_ONCE; the last value of a row is what counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size >= _BYTES_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _short(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path, pattern)
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                ids, size, start = [], 0, done
                while done < batch.num_rows and size < _BYTES_AT_ONCE:
                    ids.append(own.encode(own.matches(batch.column(1)[done].as_py())))
                    size += len(ids[-1])
                    done += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, done - start), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return encode


_CHUNKS = "row long, part int, first long, last boolean, text string"


def _cutter(size: int, overlap: int):
    schema = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1)):
                row, text = row.as_py(), text.as_py()
                for part, at in enumerate(range(0, len(text), size)):
                    yield row, part, at, at + size >= len(text), text[at : at + size + overlap]

    return lambda batches: _in_turn(rows(batches), schema)


def _splitter(path: str, pattern: str, overlap: int, size: int):
    """Chunks with their boundaries: all of them as text offsets, and those in the overlaps as places of the whole text."""
    schema = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("last", pa.bool_()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())), ("ends", pa.binary()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = _encoder(path, pattern)
        for batch in batches:
            for row, part, first, last, text in zip(*(c for c in batch.columns)):
                first, text = first.as_py(), text.as_py()
                ends = own.boundaries(text)
                certain = ends[: np.searchsorted(ends, len(text) - MARGIN, "right")]
                head = np.append(0, certain[: np.searchsorted(certain, overlap, "right")]) + first
                tail = certain[np.searchsorted(certain, size) :] + first
                yield row.as_py(), part.as_py(), first, last.as_py(), head.tolist(), tail.tolist(), ends.astype("<u4").tobytes(), text

    return lambda batches: _in_turn(rows(batches), schema)


def _pieces(path: str, pattern: str):
    """Ids of what stands between `begin` and `end` (null: the chunk's end) of each chunk, both boundaries of it."""
    schema = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = _encoder(path, pattern)
        for batch in batches:
            for row, part, first, begin, end, ends, text in zip(*batch.columns):
                text, first, stop = text.as_py(), first.as_py(), end.as_py()
                marks = np.frombuffer(ends.as_py(), "<u4").astype(np.int64)
                a, b = begin.as_py() - first, len(text) if stop is None else stop - first
                own_ends = marks[np.searchsorted(marks, a, "right") : np.searchsorted(marks, b, "right")].tolist()
                yield row.as_py(), part.as_py(), own.encode([text[x:y] for x, y in zip([a, *own_ends], own_ends)])

    return lambda batches: _in_turn(rows(batches), schema)


def _rest(path: str, pattern: str, size: int):
    """Ids of the rest of a text from the last certain place on."""

    def encode(table: pa.Table) -> pa.Table:
        own = _encoder(path, pattern)
        parts = sorted(table.select(["part", "first", "begin", "last", "text"]).to_pylist(), key=lambda r: r["part"])
        text = "".join(p["text"] if p["last"] else p["text"][:size] for p in parts)[parts[0]["begin"] - parts[0]["first"] :]
        return pa.table({"row": table.column("row").slice(0, 1), "part": pa.array([parts[0]["part"]], pa.int32()), "ids": pa.array([own.encode(own.matches(text))], pa.binary())})

    return encode


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, whole, row, part, ids): the ids of texts, as little-endian unsigned 32-bit integers.

    A text of at most `chunk` characters is one row: whole is true, row null. A longer one has a number, row, and its ids are
    those of its parts in ascending order. Null texts count as empty, and an empty text has no ids; special strings are
    ordinary text. Rows that repeat an id are documents of their own. Other columns are not read.
    """
    if overlap > chunk or overlap <= MARGIN:
        raise ValueError("chunks must be as long as their overlap, and that longer than the margin")
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    id_field = rows.schema["doc_id"]
    short = rows.where(F.length("text") <= chunk).mapInArrow(_short(ranks_path, pattern), T.StructType([id_field, T.StructField("ids", T.BinaryType())]))
    short = short.select("doc_id", F.lit(True).alias("whole"), F.lit(None).cast("long").alias("row"), F.lit(0).alias("part"), "ids")
    long = materialize(rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    cut = long.select("row", "text").mapInArrow(_cutter(chunk, overlap), _CHUNKS).repartition("row", "part")
    split = cut.mapInArrow(_splitter(ranks_path, pattern, overlap, chunk), "row long, part int, first long, last boolean, head array<long>, tail array<long>, ends binary, text string")
    split = materialize(split, "chunks")
    before = split.select("row", (F.col("part") + 1).alias("part"), "tail")
    met = split.select("row", "part", "head").join(before, ["row", "part"], "left")
    met = met.select("row", "part", F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "tail"))).alias("begin"))
    order = Window.partitionBy("row").orderBy("part")
    met = met.withColumn("sure", F.min(F.col("begin").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("end", F.lead("begin").over(order)).withColumn("next", F.lead("sure").over(order))
    placed = split.join(met, ["row", "part"])
    whole = F.col("sure") & F.coalesce("next", F.lit(True))
    sure = placed.where(whole).select("row", "part", "first", "begin", "end", "ends", "text").mapInArrow(_pieces(ranks_path, pattern), "row long, part int, ids binary")
    rest = placed.where(~whole).select("row", "part", "first", "begin", "last", "text").groupBy("row").applyInArrow(_rest(ranks_path, pattern, chunk), "row long, part int, ids binary")
    pieces = sure.unionByName(rest).join(long.select("row", "doc_id"), "row")
    return short.unionByName(pieces.select("doc_id", F.lit(False).alias("whole"), "row", "part", "ids"))


def _decoder(path: str, ids_at: int):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                data, size, start = [], 0, done
                while done < batch.num_rows and size < _BYTES_AT_ONCE:
                    ids = batch.column(ids_at)[done].as_py()
                    data.append(None if ids is None else decode_ids(ids, path))
                    size += len(data[-1] or b"")
                    done += 1
                own = batch.slice(start, done - start)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "data"])

    return decode


def decode(parts: DataFrame, ranks_path: str) -> DataFrame:
    """parts with data: the bytes of their ids. A part may end within a character; null ids give null."""
    schema = T.StructType([*parts.schema.fields, T.StructField("data", T.BinaryType())])
    return parts.mapInArrow(_decoder(ranks_path, parts.columns.index("ids")), schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digests of documents whose parts come in order; no document is held as a whole."""
    out: list[tuple] = []
    row, doc_id, n, ids_sha, data_sha = None, None, 0, None, None
    id_type = None
    for batch in batches:
        id_type = batch.schema.field(0).type
        for own_id, own_row, _, ids, data in zip(*batch.columns):
            if own_row.as_py() != row:
                if row is not None:
                    out.append((doc_id, n, ids_sha.hexdigest(), data_sha.hexdigest()))
                row, doc_id, n, ids_sha, data_sha = own_row.as_py(), own_id.as_py(), 0, hashlib.sha256(), hashlib.sha256()
            n += len(ids.as_py()) // 4
            ids_sha.update(ids.as_py())
            data_sha.update(data.as_py())
    if row is not None:
        out.append((doc_id, n, ids_sha.hexdigest(), data_sha.hexdigest()))
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(parts: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of what encode gives; its ids are decoded here, those
    of short and of long texts apart, so that each text is encoded once."""
    single = decode(parts.where("whole"), ranks_path)
    single = single.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
    ordered = decode(parts.where("not whole"), ranks_path).select("doc_id", "row", "part", "ids", "data").repartition("row").sortWithinPartitions("row", "part")
    return single.unionByName(ordered.mapInArrow(_streamed, single.schema))


def texts(parts: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text) of each document of what encode gives, decoded and joined; a document is a row again, so it fits in one."""
    single = decode(parts.where("whole"), ranks_path).select("doc_id", F.decode("data", "UTF-8").alias("text"))
    own = decode(parts.where("not whole"), ranks_path)
    joined = own.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "data"))).alias("parts"))
    return single.unionByName(joined.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")), "UTF-8").alias("text")))
