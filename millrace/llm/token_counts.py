"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_version, n_tokens) that is only ever appended to.
Content is normalised (null becomes empty; the tokenizer sees the same bytes as the digest) and digested in
the JVM; distinct contents whose digest is not cached for this tokenizer version are encoded once and their
counts appended. The counts are then joined back to all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import pick

CACHE_SCHEMA = "content_digest binary, tokenizer_version string, n_tokens long"


@cache
def _processor(path: str):
    """One per worker process; the file is read where the library is installed."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another vocabulary or setting is another version."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _counter(path: str, at_once: int = 128):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _processor(path)
        for batch in batches:
            texts = batch.column(1)
            counts: list[int] = []
            for k in range(0, len(texts), at_once):
                counts += encode(texts[k : k + at_once].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content_digest", "n_tokens"])

    return count


def _content(docs: DataFrame, text_col: str, **others: str) -> DataFrame:
    """(text, content_digest) and other columns of docs under new names."""
    text = F.coalesce("text", F.lit(""))
    return pick(docs, text=text_col, **others).withColumn("text", text).withColumn("content_digest", F.unhex(F.sha2(text.cast("binary"), 256)))


def read_cache(spark, cache_path: str) -> DataFrame:
    """The cache's rows; an empty frame where nothing has been written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text") -> None:
    """Encode the distinct contents of docs that the cache lacks for this tokenizer, and append their counts.

    Copies are dropped before the shuffle as well as after it, so a text that a third of the rows repeat is
    sent once by each map task at most. A run that is cut short leaves the cache as it was (Spark commits
    the appended files together); two runs at once may append a digest twice, which the reader resolves.
    """
    version = tokenizer_version(tokenizer_path)
    known = read_cache(docs.sparkSession, cache_path).where(F.col("tokenizer_version") == version).select("content_digest")
    distinct = _content(docs, text_col).groupBy("content_digest").agg(F.first("text").alias("text"))
    missing = distinct.join(known, "content_digest", "left_anti")
    counted = missing.mapInArrow(_counter(tokenizer_path), "content_digest binary, n_tokens long")
    counted.select("content_digest", F.lit(version).alias("tokenizer_version"), "n_tokens").write.mode("append").parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs, repeated rows included.

    Whole texts, without begin, end or added special tokens; strings of special tokens are treated as the
    library does by default. A null text counts as empty: 0 bytes and what the library gives for "". A null
    id stays null. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    fill_cache(docs, tokenizer_path, cache_path, text_col)
    version = tokenizer_version(tokenizer_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_version") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = _content(docs, text_col, doc_id=id_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    return rows.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
