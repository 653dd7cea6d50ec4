"""Product quantisation of vectors on integers, with float32 screening and exact decisions.

Components become integers, vectors are cut into equal parts, and each part position has a codebook that rounds of
assignment and averaging refine. A round is one pass over the vectors: every task assigns its parts and returns sums and
counts of each codebook entry, which are added up by entry; only the codebooks (parts x entries x positions integers)
travel to the driver and back.

The nearest entry is found in two steps. A float32 matrix product gives |c|^2 - 2 x.c for all entries of a part at once.
Its error is bounded: a product of p terms, in any order of summation, differs from the exact one by at most
gamma(p) |x| |c| with gamma(p) = p u / (1 - p u) and u = 2^-24; rounding of the operands, of |c|^2, of the difference and of
the bound itself adds a few u. Every entry whose interval overlaps that of the best one is evaluated again
in int64, and the least exact distance, of the lowest index, wins. So codes don't depend on the order of summation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import materialize, pick

SCALE = 1024
_U = 2.0**-24
_AT_ONCE = 4096
#: Integer components of this size and more could give distances beyond 64 bits.
_LIMIT = 1 << 26


@dataclass
class Codebooks:
    """entries: parts x entries x positions, int64. dim: the length of the vectors they are for."""

    entries: np.ndarray
    dim: int

    def digest(self) -> str:
        """SHA-256 of all components, decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (int64, below _LIMIT in size) the index of the nearest row of book (the lowest of equals) and the
    exact squared distance."""
    p = x.shape[1]
    squares = (book * book).sum(axis=1)
    screen = squares.astype(np.float32)[None, :] - np.float32(2) * (x.astype(np.float32) @ book.astype(np.float32).T)
    # in float64, whose own errors the last factor covers: both operands are rounded (2u), the product has gamma(p), and
    # |c|^2 and the difference are rounded by u of at most |c|^2 + 2 |x| |c| each
    gamma = (p + 4) * _U / (1 - (p + 4) * _U)
    length, longest = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)), np.sqrt(float(squares.max()))
    error = 1.01 * (2 * gamma * length * longest + 2 * _U * (longest * longest + 2 * length * longest)) + 1e-3
    least = screen.min(axis=1)
    at, entry = np.nonzero(screen <= (least.astype(np.float64) + 2 * error)[:, None])
    exact = ((x[at] - book[entry]) ** 2).sum(axis=1)
    starts = np.searchsorted(at, np.arange(len(x)))
    best = np.minimum.reduceat(exact, starts)
    wins = np.flatnonzero(exact == best[at])
    first = wins[np.searchsorted(at[wins], np.arange(len(x)))]
    return entry[first], best


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a list column are kept, and floor(SCALE * x) of these as int64."""
    keep = np.zeros(len(column), bool)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    right = np.flatnonzero(np.nan_to_num(np.asarray(lengths, np.float64), nan=-1) == dim)
    values = column.take(pa.array(right)).flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = x * SCALE
        good = (np.abs(x) <= _LIMIT - 1).all(axis=1)
    keep[right[good]] = True
    return keep, np.floor(x[good]).astype(np.int64)


def _assign(x: np.ndarray, books: Codebooks) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, part, components, codes, distances), a slice of rows at a time."""
    parts, _, width = books.entries.shape
    for k in range(0, len(x), _AT_ONCE):
        rows = slice(k, min(k + _AT_ONCE, len(x)))
        for part in range(parts):
            own = np.ascontiguousarray(x[rows, part * width : (part + 1) * width])
            yield rows, part, own, *nearest(own, books.entries[part])


def _summer(books: Codebooks):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, width = books.entries.shape
        sums = np.zeros((parts, n, width + 1), np.int64)  # counts last
        for batch in batches:
            _, x = integers(batch.column(0), books.dim)
            for _, part, own, code, _ in _assign(x, books):
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                sums[part, used, :width] += np.add.reduceat(own[order], starts, axis=0)
                sums[part, used, width] += np.diff(np.append(starts, len(code)))
        part, entry = np.nonzero(sums[:, :, width])
        got = sums[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(width + 1))], names=["part", "entry", *(f"s{k}" for k in range(width + 1))])

    return add


def _coder(books: Codebooks):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books.entries)
        for batch in batches:
            keep, x = integers(batch.column(2), books.dim)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for rows, part, _, own, distance in _assign(x, books):
                codes[rows, part] = own
                error[rows] += distance
            kept = batch.filter(pa.array(keep))
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return code


def _first_vectors(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The codebooks to start from: the kept vectors of the smallest ids, one after another as they are kept; which are kept
    is decided in the tasks."""
    lengths = F.when(F.size("vector") % parts == 0, F.size("vector"))
    sound = rows.where(lengths > 0).where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) * SCALE > _LIMIT - 1)))
    ids = F.col("vec_id").asc_nulls_last()
    head = sound.orderBy(ids, "vector").select(F.size("vector").alias("dim")).first()
    if head is None:
        return None
    dim = head["dim"]
    got = sound.where(F.size("vector") == dim).orderBy(ids, "vector").limit(entries).select("vector").toArrow().column(0).combine_chunks()
    _, x = integers(got, dim)
    return Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2)), dim)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all kept vectors; None where none is kept.

    Kept are vectors of the length of the kept one with the smallest id (null ids come last, equal ids by their
    vectors), a multiple of `parts`, without null or non-finite components, and without such of 2^16 and more, whose
    distances 64 bits might not hold. Fewer vectors than entries give shorter codebooks. An entry without a part stays.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = pick(vectors, vec_id=id_col, vector=vector_col)
    books = _first_vectors(rows, parts, entries)
    if books is None:
        return None
    width = books.entries.shape[2]
    names = [f"s{k}" for k in range(width + 1)]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names)])
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_summer(books), schema).groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        at = (sums.column("part").to_numpy(), sums.column("entry").to_numpy())
        total = np.stack([sums.column(n).to_numpy() for n in names], axis=1)
        entry = books.entries.copy()
        entry[at] = total[:, :width] // total[:, width:]
        books = Codebooks(entry, books.dim)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) for each kept row, repeated ones included: two hex digits a part, and the squared
    distances to the entries, added up. Without codebooks there are no rows. Other columns are not read."""
    rows = pick(vectors, vec_id=id_col, label=label_col, vector=vector_col)
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_coder(books), schema)


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", out_col: str = "approximation") -> DataFrame:
    """codes with the approximated vector, as array<double>; a null code gives null."""
    flat = books.entries / SCALE
    parts, _, width = flat.shape
    values = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in flat.reshape(-1, width)))
    at = [F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int") + p * flat.shape[1] for p in range(parts)]
    return codes.withColumn(out_col, F.when(F.col(code_col).isNotNull(), F.concat(*(F.get(values, i) for i in at))))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): see fit and encode. Errors of equal labels are added up, nulls
    together, before they are joined to the rows, so a label of many rows is combined within the tasks first."""
    books = fit(vectors, id_col, vector_col, **options)
    coded = materialize(encode(vectors, books, id_col, vector_col, label_col), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    c, s = coded.alias("c"), sums.alias("s")
    joined = c.join(s, F.expr("c.label <=> s.label"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def _rounds_sql(rounds: int, parts: int = 4, entries: int = 256) -> str:
    """The rounds as a chain of DuckDB common table expressions; a distance and an index are compared as one integer."""
    sql = f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, (r - 1)::BIGINT AS e, x AS c FROM parts WHERE r <= {entries}),
"""
    for k in range(rounds + 1):
        sql += f"""a{k} AS MATERIALIZED (
  SELECT r, parts.p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {entries} + e) AS best
  FROM parts JOIN b{k} AS b ON parts.p = b.p GROUP BY r, parts.p),
"""
        if k < rounds:
            sql += f"""s{k} AS (
  SELECT p, best % {entries} AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m
  FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} AS b LEFT JOIN m{k} AS m ON b.p = m.p AND b.e = m.e),
"""
    return sql + f"""digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (
  SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), digest
"""


OP13_SQL = _rounds_sql(4)
