"""The pipeline against brute force, stage by stage on its own input."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_near_duplicates import brute_components, brute_fingerprint
from tokenizers import Tokenizer

from millrace.llm import decontamination, mixing, toxicity
from millrace.llm._shared import materialize

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(materialize(stage(spark, outs[-1], SF), f"test-{name}"))
    assert all(o.columns == names for o in outs[:5])
    rows = [{r["doc_id"]: r["text"] for r in o.collect()} for o in outs[:4]]

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    words = model.words()

    def score(text):
        s = [model.bias + sum(words[w] for w in toxicity._WORD.findall(x)) for x in toxicity._SENTENCE.findall((text or "").lower()) if toxicity._WORD.search(x)]
        return 1 - np.prod([1 - 1 / (1 + np.exp(-min(max(x, -500), 500))) for x in s])

    assert set(rows[1]) == {k for k, t in rows[0].items() if score(t) < toxicity.THRESHOLD}

    parts = brute_components({k: brute_fingerprint(t) for k, t in rows[1].items()})
    assert set(rows[2]) == set(parts.values())

    bench = decontamination.Benchmark([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 5, 0.8)
    assert set(rows[3]) == {k for k, t in rows[2].items() if not bench.search(decontamination.words_of(t))}

    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(outs[3]).collect()}
    got = {}
    mixed = [(r["doc_id"], r["text"]) for r in outs[4].collect()]
    for k, t in mixed:
        got[k] = got.get(k, 0) + len(t.split())
    assert got == {k: v for k, v in plan.items() if v}

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    ids = {(k, t): np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in set(mixed)}
    stored = outs[5].orderBy("start").collect()
    assert [r["doc_id"] for r in stored] == sorted(k for k, _ in mixed)
    for r in stored:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((k, len(ids[k, t]), zlib.crc32(ids[k, t].tobytes())) for k, t in mixed)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stored) == want

    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.select("doc_id", "n_tokens", "ids_crc32").collect())) == want
