"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints at distance 2 or less, one
segment differs in at most one bit, so the two share a variant of that segment with one bit replaced by a
wildcard. Each distinct fingerprint is indexed under its 64 variants; an equality join on them (done as a
grouping, since only distinct fingerprints take part) gives candidates, which are verified by their
Hamming distance.

A variant shared by exactly two fingerprints gives one candidate pair. Where more share it, no pairs are
listed: two fingerprints are within two bits of each other exactly if some 64-bit value is within one bit
of both, so members of such variants are grouped by the 65 values within one bit of them. All that share
such a value are linked truly, without a check and without listing pairs. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import carried, materialize, pick
from millrace.llm.components import connected_components

_ROWS, _PRINTS = 16_384, 16_384


def simhash64(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text: unsigned 64 bits, a bit is set if more than half of the shingle hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    hashed, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _ROWS):
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[k : k + _ROWS], ends[k : k + _ROWS])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
        prints = np.fromiter(map(simhash64, batch.column(1).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long. A null or empty text has fingerprint 0."""
    picked = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return picked.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _variants(prints: DataFrame) -> DataFrame:
    """(key, fp): 32 one-wildcard variants of each half; key holds the half's number, the bit and the other bits."""
    half = F.when(F.col("seg") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    rows = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).select("fp", "seg", half.alias("half"))
    rows = rows.select("fp", "seg", "half", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    masked = F.expr("half & ~shiftleft(1L, bit)")
    return rows.select((F.shiftleft((F.col("seg") * 32 + F.col("bit")).cast("long"), 32) + masked).alias("key"), "fp")


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """prints(fp, distinct) -> edges (a, b) whose components are those of all pairs within max_bits (at most 2)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments hold distances of 0 to 2")
    prints = materialize(prints, "prints")
    # a few files of prints become 64 times as many rows, so they are dealt to as many tasks as that asks for
    variants = _variants(prints.repartition(1 + prints.count() // _PRINTS, "fp"))
    shared = materialize(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "variants")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = shared.where("n = 2").where(near).select("a", "b").distinct()
    crowded = materialize(variants.join(shared.where("n > 2").select("key").hint("shuffle_hash"), "key", "left_semi").select("fp").distinct(), "crowded")
    ball = crowded.repartition(1 + crowded.count() // _PRINTS, "fp").select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit"))
    if max_bits == 2:
        ball = ball.select("fp", F.expr("if(bit < 0, fp, fp ^ shiftleft(1L, bit))").alias("mid"))
        met = ball.groupBy("mid").agg(F.count("*").alias("n")).where("n > 1").select("mid")
        near_many = ball.join(met, "mid").select(F.col("fp").alias("a"), F.col("mid").alias("b"))
    elif max_bits == 1:
        ball = ball.where("bit >= 0").select("fp", F.expr("fp ^ shiftleft(1L, bit)").alias("other"))
        near_many = ball.join(crowded.select(F.col("fp").alias("other")), "other").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    else:
        return pairs.limit(0)
    return pairs.unionByName(near_many)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of max_bits or fewer bits reach.

    One row for each row of docs, repeated rows included. Null and empty texts have fingerprint 0 and link
    like any other. A null doc_id stays and gets its component; it never names one unless all its members
    are null. An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    parts = materialize(connected_components(links(prints.select("fp"), max_bits)), "parts")
    placed = prints.join(parts, prints.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(named, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """The rows of docs that stay when one of each component of near-duplicates stays: that with the smallest id.

    Of rows that repeat that id one stays. All columns are kept, whatever their names; a null id stays only where
    its component has no other.
    """
    rows, at, back = carried(docs)
    marked = materialize(rows.withColumn("n", F.monotonically_increasing_id()), "simhash-docs")  # read twice, so numbered once
    found = near_duplicates(marked.select("n", at(text_col).alias("text")), "n", "text", max_bits).select(F.col("doc_id").alias("n"), "component_id")
    ids = marked.select("n", at(id_col).alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "n"))["n"]
    kept = found.join(ids, "n").groupBy("component_id").agg(first.alias("n")).select("n")
    return back(marked.join(kept.hint("shuffle_hash"), "n", "left_semi"))
