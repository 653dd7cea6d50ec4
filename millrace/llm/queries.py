"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, decontamination, language_id, lexical_search, media_columns, mixing, simhash_dedup, substring_dedup, token_counts, token_store, toxicity, vector_codes, warc
from millrace.llm._shared import shared_path
from millrace.llm.labelled import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache of its own, so every distinct text is encoded; a service would keep the path."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), shared_path(spark, "token-cache"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.store_and_describe(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that shares a passage of 50 words or more with another."""
    return substring_dedup.duplicate_documents(substring_dedup.repeated_passages(_table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).drop("target_uri")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, store)
    return token_store.read_store(spark, store)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(_table(spark, sf_dir, "documents"), path), path)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "postings")
    lexical_search.build_index(_table(spark, sf_dir, "documents"), folder)
    return lexical_search.search(lexical_search.read_index(spark, folder), _table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_media_columns": op2_media_columns,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_token_store": op8_token_store,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op4_warc": warc.OP4_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
