import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import token_counts, token_store
from millrace.llm._shared import shared_path

SCHEMA = "doc_id long, text string, content_digest string, digest string"
TEXTS = [None, "", " ", "The  quick\nbrown fox.", "x<|endoftext|> y", "é ß 漢字 😀", "it's 'tis don't", "a " * 5000, "same", "same"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "z", "z") for i, t in enumerate(texts)] + [(None, "same", "z", "z")], SCHEMA)


def test_counts_are_the_librarys(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(docs(spark), path, shared_path(spark, "cache")).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(TEXTS)] + [(None, 4, len(sp.encode("same")))]
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got))) == sorted(map(str, want))
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_only_misses_are_encoded_and_appended(spark):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "cache")
    token_counts.fill_cache(docs(spark, ["a b", "c"]), path, cache)
    assert token_counts.read_cache(spark, cache).count() == 3
    token_counts.fill_cache(docs(spark, ["a b", "c", "new one", "new one"]), path, cache)
    assert token_counts.read_cache(spark, cache).count() == 4
    # a count in the cache is believed: what is known is not encoded again
    version = token_counts.tokenizer_version(path)
    other = shared_path(spark, "cache")
    spark.createDataFrame([("q",)], "t string").select(F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("content_digest"), F.lit(version).alias("tokenizer_version"), F.lit(77).cast("long").alias("n_tokens")).write.parquet(other)
    assert token_counts.token_counts(spark.createDataFrame([(1, "q")], "doc_id long, text string"), path, other).first()["n_tokens"] == 77


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(docs(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "cache")).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_units_give_the_ids_of_whole_texts(encoder, monkeypatch):
    r = random.Random(5)
    alphabet = [" ", "  ", "\n", "a", "the", ".", "'s", "é", "À", "ÿ", "×", "1", "\t", "<|endoftext|>", "漢", "\x1c", "\xa0", " word", "...", "$$$"]
    cases = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["word " * 300, "x" * 400, ""]
    want = [encoder.direct(c) for c in cases]
    assert [x.tobytes() for x in encoder.encode([c.encode() for c in cases])] == want
    monkeypatch.setattr(token_store, "_GROUP_BYTES", 60)
    assert [x.tobytes() for x in encoder.encode([c.encode() for c in cases])] == want


def test_units_whose_polynomial_hashes_are_equal(encoder):
    """Words of Thue and Morse and their complements collide in every polynomial hash modulo a power of two."""
    for n in (10, 11, 12):
        one = "".join("ab"[k.bit_count() % 2] for k in range(1 << n))
        two = "".join("ba"[k.bit_count() % 2] for k in range(1 << n))
        cases = [one, two, f"x {one} {two}", " " + two]
        assert [x.tobytes() for x in encoder.encode([c.encode() for c in cases])] == [encoder.direct(c) for c in cases]
    near = ["a" * k for k in range(1, 40)] + ["a" * k + "\0" for k in range(1, 20)] + ["b" * 8 + "a" * k for k in range(12)]
    cases = [" ".join(near), *near]
    assert [x.tobytes() for x in encoder.encode([c.encode() for c in cases])] == [encoder.direct(c) for c in cases]


def test_store_round_trip(spark):
    path, store = public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "store")
    token_store.write_store(docs(spark), path, 2, store)
    model = Tokenizer.from_file(path)
    rows = sorted([(-1, None, "same")] + [(i, i, t) for i, t in enumerate(TEXTS)])
    want, start = [], 0
    for _, doc_id, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_store.read_store(spark, store).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    back = {r["start"]: r["ids"] for r in token_store.read_ids(spark, store).collect()}
    assert zlib.crc32(np.array(back[want[5][1]], "<u4").tobytes()) == want[5][3]
    chunks = token_store._packed(spark, store, "chunks")
    assert chunks.count() == chunks.select("name").distinct().count()
    listed = spark.read.parquet(f"{store}/recipes").orderBy("start").select("doc_id").collect()
    assert [r[0] for r in listed] == [None, *range(len(TEXTS))]


def test_a_damaged_chunk_is_found(spark):
    path, store = public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "store")
    token_store.write_store(docs(spark, ["one two", "three"]), path, 2, store)
    bad = token_store._packed(spark, store, "chunks").withColumn("payload", F.lit(b"\1\0").cast("binary")).withColumn("n_tokens", F.lit(1).cast("long")).withColumn("kind", F.lit("chunks"))
    rest = token_store._packed(spark, store, "recipes").withColumn("kind", F.lit("recipes"))
    copy = shared_path(spark, "store")
    bad.unionByName(rest).write.partitionBy("kind").parquet(f"{copy}/packed")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{store}/{name}").write.parquet(f"{copy}/{name}")
    with pytest.raises(Exception, match="does not hold"):
        token_store.read_store(spark, copy).collect()


def test_lost_doubled_and_altered_recipes_are_found(spark, monkeypatch):
    monkeypatch.setattr(token_store, "RUN", 3)
    store = shared_path(spark, "store")
    token_store.write_store(docs(spark, [f"text {k} " * k for k in range(1, 12)]), public_tokenizers.path("byte_bpe_50k.json"), 2, store)
    recipes, manifest = (spark.read.parquet(f"{store}/{name}") for name in ("recipes", "manifest"))
    levels = {r["level"]: r["count"] for r in manifest.groupBy("level").count().collect()}
    assert levels["store"] == 1 and levels["run"] > levels["part"] >= 1
    assert token_store.read_store(spark, store).count() == recipes.count()

    def damaged(recipes, manifest=manifest):
        copy = shared_path(spark, "store")
        spark.read.parquet(f"{store}/packed").write.partitionBy("kind").parquet(f"{copy}/packed")
        recipes.write.parquet(f"{copy}/recipes")
        manifest.write.parquet(f"{copy}/manifest")
        return copy

    last = recipes.agg(F.max("start")).first()[0]
    cases = [recipes.where(F.col("start") < last), recipes.unionByName(recipes.where("start = 0")), recipes.withColumn("start", F.when(F.col("start") == last, last + 1).otherwise(F.col("start"))), recipes.withColumn("root", F.lit(b"x").cast("binary")), recipes.where("run > 0")]
    for copy in [*map(damaged, cases), damaged(recipes, manifest.where("level <> 'run'"))]:
        with pytest.raises(ValueError, match="manifest"):
            token_store.read_store(spark, copy)


def test_store_of_nothing(spark):
    store = shared_path(spark, "store")
    token_store.write_store(docs(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json"), 2, store)
    assert token_store.read_store(spark, store).count() == 0


def test_chunks_follow_content():
    r = np.random.default_rng(1)
    a = r.integers(0, 50_000, 9000).astype("<u2")
    b = np.concatenate([r.integers(0, 50_000, 137).astype("<u2"), a])
    cut = lambda x: [x[i:j].tobytes() for i, j in zip([0, *token_store.cut_points(x)], token_store.cut_points(x))]
    assert b"".join(cut(a)) == a.tobytes() and len(set(cut(a)) & set(cut(b))) >= len(cut(a)) - 3
    ends = np.cumsum([len(a), 3, len(b), 1])
    every = np.concatenate([a, a[:3], b, b[:1]])
    assert token_store.many_cut_points(every, ends) == [token_store.cut_points(x) for x in (a, a[:3], b, b[:1])]
    same = np.zeros(20_000, "<u2")
    assert max(np.diff([0, *token_store.cut_points(same)])) <= token_store.MAX_CHUNK


def test_crc32_of_concatenations():
    r = np.random.default_rng(2)
    parts = [r.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4") for n in (1, 7, 300, 4096)]
    for size in (1, 40):
        crc = np.full(size, zlib.crc32(parts[0].tobytes()), np.uint32)
        for p in parts[1:]:
            crc = token_store.combine_crc32(crc, np.full(size, zlib.crc32(p.tobytes()), np.uint32), np.full(size, len(p)))
        assert set(crc.tolist()) == {zlib.crc32(b"".join(p.tobytes() for p in parts))}
