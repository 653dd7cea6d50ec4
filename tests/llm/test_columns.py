"""Columns that no operator knows, with names that clash with its own or need quoting, come through unharmed."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, language_id, media_columns, mixing, simhash_dedup, substring_dedup, token_counts, token_store, toxicity
from millrace.llm._shared import shared_path

ODD = ["__row", "__words", "__stamp", "__size", "__part", "my col", "a.b", "`q`", "Text", "row", "n", "size", "words", "uid", "stamp", "c0", "c1"]
BENCH = "alpha beta gamma delta epsilon zeta eta theta"


@pytest.fixture
def docs(spark):
    rows = [(k, f"text number {k} of some words and {' '.join('xyz'[j % 3] * (k + 1) for j in range(9))}", "ab"[k % 2], 5) for k in range(6)] + [(6, BENCH, "a", 1), (7, BENCH + " x", "b", 1), (7, BENCH + " x", "b", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for k, name in enumerate(ODD):
        df = df.select("*", F.lit(f"value {k}").alias(name)) if name != "a.b" else df.select("*", F.struct(F.lit(k).alias("in ner")).alias(name))
    return df


def same_columns(out, docs, drop=()):
    names = [n for n in docs.columns if n not in drop]
    assert out.columns[: len(names)] == names
    want = {n: f"value {k}" for k, n in enumerate(ODD)}
    rows = out.collect()
    for r in rows:
        for n, x in zip(out.columns, r):
            if n == "a.b":
                assert x[0] == ODD.index("a.b")
            elif n in want:
                assert x == want[n]
    return rows


def test_stages(spark, docs):
    bench = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    for most in (1 << 20, 0):
        assert {r[0] for r in same_columns(decontamination.remove_leaks(docs, bench, most_seed_bytes=most), docs)} == {None, *range(6)}
    assert {r[0] for r in same_columns(simhash_dedup.keep_one(docs), docs)} >= {0, None}
    model = toxicity.train(["a b", "awful x"], __import__("numpy").array([0, 1]))
    assert len(same_columns(toxicity.reject(docs, model, threshold=1.1 - 0.2), docs)) == 10
    same_columns(toxicity.score(docs, model), docs)
    taken = same_columns(mixing.take(docs), docs)
    assert sum(len(r[1].split()) for r in taken) == pytest.approx(sum(len((r[1] or "").split()) for r in docs.collect()), abs=2)


def test_the_others(spark, docs):
    same_columns(language_id.predict(docs, None), docs)
    assert language_id.fit(docs, lang_col="source") is not None
    assert toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"), "my col")) is not None
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.token_counts(docs, path, shared_path(spark, "cache")).count() == 10
    store = shared_path(spark, "store")
    token_store.write_store(docs, path, 2, store)
    assert token_store.read_store(spark, store).count() == 10
    assert media_columns.store_and_describe(docs).count() == 10
    assert simhash_dedup.near_duplicates(docs).count() == 10
    assert substring_dedup.repeated_passages(docs).count() == 0
    assert mixing.mix(docs).count() == 10
