"""Byte-level BPE, ranked search and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from millrace.llm import byte_bpe, lexical_search, vector_codes
from millrace.llm._shared import shared_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, row long, part int, ids string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def bytes_of(ids):
    return np.array(ids, "<u4").tobytes()


def test_classes_are_the_librarys(library):
    own = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    _, odd = byte_bpe._classes()
    r = random.Random(3)
    alphabet = [*sorted(odd)[::400], " ", "  ", "\n", "a", "É", "7", "½", "'s", "'", "\x1c", "\x85", "\xa0", "漢", "😀", "̀", "x<|endoftext|>"]
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        assert own.encode(own.matches(text)) == bytes_of(library.encode_ordinary(text))


def test_chunks_meet(spark, library):
    r = random.Random(4)
    alphabet = [" ", "  ", "\n\n", " the", "word", "'re", "'", "12", "...", "é", "漢字", "\t", "$"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 700))) for _ in range(60)]
    # runs that are longer than the overlap, at the start, across chunks and to the end
    texts += ["a" * 1000, "ab " * 90 + "x" * 300 + " cd" * 200, " " * 500 + "y", "tail" * 50 + " " * 400, "'re" * 300, "12 " * 40 + "=" * 150 + " end of it " * 40, None, "", "same", "same"]
    docs = spark.createDataFrame([(k // 2, t, 5, 6, "z") for k, t in enumerate(texts)] + [(None, "b " * 200, 1, 1, "q")], SCHEMA)
    want = sorted((str(d), (t or "")) for d, t in [(k // 2, t) for k, t in enumerate(texts)] + [(None, "b " * 200)])
    encoded = byte_bpe.encode(docs, RANKS, chunk=64, overlap=40)
    assert sorted((str(x["doc_id"]), x["text"]) for x in byte_bpe.texts(encoded, RANKS).collect()) == want
    got = sorted((str(x["doc_id"]), x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in byte_bpe.digests(encoded, RANKS).collect())
    assert got == sorted((d, len(ids := library.encode_ordinary(t)), hashlib.sha256(bytes_of(ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in want)
    assert encoded.groupBy("row").count().where("row is not null and count > 3").count() > 30


def test_bpe_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.digests(byte_bpe.encode(docs, RANKS), RANKS).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, RANKS, chunk=10, overlap=20)


def plain_search(docs, items, k):
    found = [(d, re.findall(lexical_search.TERMS, re.sub("[A-Z]", lambda c: c[0].lower(), t))) for d, t in docs if t is not None]
    found = [(d, t) for d, t in found if t]
    n_docs, length = len(found), sum(len(t) for _, t in found)
    df = Counter(t for _, own in found for t in set(own))
    out = []
    for item, text in items:
        scores = []
        for d, own in found:
            tf, m = Counter(own), 10 + 90 * len(own) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(re.findall(lexical_search.TERMS, re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))) if t in tf)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def searched(spark, docs, items, k, probe):
    docs = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], "doc_id long, text string, term string, n int")
    items = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, uid string")
    folder = shared_path(spark, "postings")
    lexical_search.build_index(docs, folder, buckets=3, block_terms=90, block_docs=7)
    found = lexical_search.search(lexical_search.read_index(spark, folder), items, k, buckets=3, probe=probe)
    return sorted(str(tuple(r)) for r in found.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("probe", [1, 40])
def test_search_is_exact(spark, probe):
    r = random.Random(6)
    words = [w for k in range(80) for w in [f"w{k}"] * (1 + 160 // (k + 1))] + ["Éa", "éa", "漢字", "a-b", "A_b"]
    docs = [(k, r.choice([" ", ", ", "\x7f"]).join(r.choices(words, k=r.randint(1, 60)))) for k in range(150)]
    docs += [(200 + k, docs[3][1]) for k in range(20)] + [(5, docs[3][1]), (None, docs[3][1]), (None, None), (300, ""), (301, " . "), (302, "W1 " * 5000)]
    items = [(k, " ".join(r.choices(words, k=r.randint(1, 15)))) for k in range(12)] + [(50, docs[3][1]), (51, None), (52, ""), (53, "nowhere"), (54, "w0 W0"), (55, "w77")]
    assert searched(spark, docs, items, 4, probe) == plain_search(docs, items, 4)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")], 4, 1) == []
    assert searched(spark, [(1, "a b")], [], 4, 1) == []
    assert searched(spark, [(1, None)], [(1, "a")], 4, 1) == []
    assert searched(spark, [(1, "a")], [(1, "a")], 4, 1) == plain_search([(1, "a")], [(1, "a")], 4)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(best(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(own[e]) for col in zip(*own[e])] if e in own else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    coded = [(i, label, [best(c[p], books[p]) for p in range(parts)]) for (i, _, label), c in zip(kept, cut)]
    errors = Counter()
    for _, label, b in coded:
        errors[label] += sum(d for d, _ in b)
    return sorted(str((i, "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b), errors[label], digest)) for i, label, b in coded)


def coded(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "z", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    return sorted(str(tuple(r)) for r in vector_codes.compress(df, **options).collect())


def test_codes_are_exact(spark):
    r = np.random.default_rng(5)
    rows = [(int(k), [float(np.float32(x)) for x in r.normal(0, 1 if k % 3 else 1e-3, 8)], [None, 1, 2][k % 3]) for k in r.permutation(90)]
    rows += [(k, rows[0][1], 1) for k in range(100, 120)] + [rows[1], rows[1], (None, rows[2][1], None)]
    rows += [(-1, None, 1), (-2, [1.0] * 7 + [None], 1), (-3, [float("nan")] + [0.0] * 7, 1), (-4, [float("inf")] * 8, 1), (-5, [0.0] * 7 + [-float("inf")], None)]
    for entries, rounds in ((16, 4), (256, 2)):
        assert coded(spark, rows, entries=entries, rounds=rounds) == plain_codes(rows, entries=entries, rounds=rounds)


def test_codes_of_odd_tables(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1), (2, [None] * 4, 1), (3, [1.0] * 5, 2)]) == []
    assert len(coded(spark, [(1, [1.0] * 4, None)])) == 1
    # vectors of another length, and such whose distances don't fit, are left out
    assert [x[:3] for x in coded(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1), (3, [3e38] * 4, 1), (4, [-70000.0] * 4, 1)])] == ["(1,"]


def test_nearest_resolves_what_float32_cannot():
    r = np.random.default_rng(8)
    for size in (3, 1000, (1 << 26) - 1):
        book = r.integers(-size, size, (64, 16))
        book[40:] = book[r.integers(0, 40, 24)]  # equal entries
        book[30:40] = book[:10] + r.integers(-1, 2, (10, 16))  # nearly equal ones
        x = np.clip(book[r.integers(0, 64, 300)] + r.integers(-2, 3, (300, 16)), 1 - (1 << 26), (1 << 26) - 1)
        code, distance = vector_codes.nearest(x, book)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book)) for v in x]
        assert list(zip(distance.tolist(), code.tolist())) == want


def test_codes_approximate(spark):
    df = spark.createDataFrame([(k, [float(k % 7), 0.5, -1.0, k / 9], 1) for k in range(30)], "vec_id long, embedding array<double>, label int")
    books = vector_codes.fit(df)
    got = vector_codes.decode(vector_codes.encode(df, books), books).join(df, "vec_id").select("approximation", "embedding").collect()
    assert len(got) == 30 and all(abs(a - b) <= 1 / 1024 for r in got for a, b in zip(r[0], r[1]))


def test_integers_keep_places():
    column = pa.array([None, [1.0, 2.0], [1.0], [float("nan"), 0.0], [None, 1.0], [-0.0001, 0.0]], pa.list_(pa.float32()))
    keep, x = vector_codes.integers(column, 2)
    assert keep.tolist() == [False, True, False, False, False, True] and x.tolist() == [[1024, 2048], [-1, 0]]
