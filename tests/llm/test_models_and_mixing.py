import hashlib
import zlib

import numpy as np
from oracle import connect, rows
from pyspark.sql import functions as F

from millrace.llm import language_id as L
from millrace.llm import mixing as X
from millrace.llm import queries
from millrace.llm import toxicity as T
from millrace.llm.labelled import sample_by_label

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in labels if got[i]["held_out"]]
    pos, neg = ([got[i]["score"] for i in held if labels[i] == v] for v in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.9 and np.mean([s >= 0.3 for s in neg]) < 0.03
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_noisy_or_is_what_it_says_and_finds_sentences(spark):
    texts = [f"nice day number {i}. all is well." for i in range(200)] + [f"good start {i}. you are awful! fine end." for i in range(60)]
    model = T.train(texts, np.array([0] * 200 + [1] * 60))
    df = spark.createDataFrame([(1, "all well. you awful. bye", "a"), (2, None, "a"), (3, "", "a"), (4, "...", "a"), (5, "fine day", "a"), (5, "fine day", "a"), (None, "word " * 20_000, "a")], "doc_id long, text string, score string")
    got = T.score(df, model).collect()
    assert len(got) == 7 and got[0]["score"] > 0.5
    hit = got[0]["offending"][0]
    assert "all well. you awful. bye"[hit["start"] : hit["end"]].strip() == "you awful" and len(got[0]["offending"]) == 1
    words = model.words()
    by_hand = 1.0
    for s in ("all well", "you awful", "bye"):
        by_hand *= 1 - 1 / (1 + np.exp(-(model.bias + sum(words[w] for w in s.split()))))
    assert abs(got[0]["score"] - (1 - by_hand)) < 1e-9
    assert [r["score"] for r in got[1:4]] == [0, 0, 0] and got[4]["score"] < 0.3
    assert T.score(df.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.score(docs, model).first()["score"] < 0.3


def test_language_on_held_out_rows(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op6_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.97


def test_language_edges(spark):
    rows_ = [(i, "the cat and the dog " * 4, "en") for i in range(40)] + [(100 + i, "der hund und die katze " * 4, "de") for i in range(40)]
    rows_ += [(200, None, None), (201, "", "en"), (202, "123 ...", None), (203, "der hund", None), (203, "der hund", None), (None, "the cat " * 9000, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(df.select("doc_id", "text"), L.fit(df)).collect()}
    assert [got[k] for k in (200, 201, 202)] == [("und", 0.0)] * 3
    assert got[203][0] == "de" and got[None][0] == "en" and 0 < got[None][1] <= 1
    assert L.fit(df.limit(0)) is None
    assert L.predict(df.select("doc_id", "text"), None).where("lang_pred <> 'und'").count() == 0


def test_gradients_of_the_network():
    """The trained network fits what a bag of bytes can't tell apart."""
    r = np.random.default_rng(0)
    x = r.integers(97, 123, (400, 24)).astype(np.uint8)
    y = r.integers(0, 2, 400)
    for k in range(400):
        x[k, 5:8] = [97, 98, 99] if y[k] else [99, 98, 97]
    model = L.train(x, y, ["no", "yes"], epochs=40)
    assert (L.log_probabilities(model, x).argmax(axis=1) == y).mean() > 0.98


def plain_log_probabilities(model, window):
    """The network by loops over places and filters."""
    e = [model.embed[b] for b in window] + [model.embed[0]] * (L._WIDE - 1)
    pooled = []
    for f in range(model.filters.shape[1]):
        w = model.filters[:, f].reshape(L._WIDE, L.DIM)
        pooled.append(max(sum(float(e[i + k] @ w[k]) for k in range(L._WIDE)) for i in range(len(window))) + model.filter_bias[f])
    z = np.maximum(pooled, 0) @ model.out + model.out_bias
    return z - np.log(np.exp(z - z.max()).sum()) - z.max()


def small_model(r, languages=3):
    n = len(L.WIDTHS) * L.EACH
    p = [r.normal(0, 0.5, (256, L.DIM)), r.normal(0, 0.3, (L._WIDE * L.DIM, n)), r.normal(0, 0.1, n), r.normal(0, 0.4, (n, languages)), r.normal(0, 0.1, languages)]
    p[0][0] = 0
    return L.Model(list("abc")[:languages], *p)


def test_the_network_is_what_the_loops_say():
    r = np.random.default_rng(3)
    model, x = small_model(r), r.integers(0, 256, (5, 20)).astype(np.uint8)
    x[2, 12:] = 0
    got = L.log_probabilities(model, x)
    assert np.allclose(got, [plain_log_probabilities(model, w) for w in x])


def test_gradients_are_finite_differences():
    r = np.random.default_rng(4)
    model, x, y = small_model(r), r.integers(1, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    names = ["embed", "filters", "filter_bias", "out", "out_bias"]
    loss = lambda: -L.log_probabilities(model, x)[np.arange(6), y].mean()
    for name, g in zip(names, L.gradients(model, x, y)):
        own = getattr(model, name)
        for _ in range(25):
            at = tuple(int(r.integers(0, s)) for s in own.shape)
            if name == "embed":
                at = (int(x[r.integers(0, 6), r.integers(0, 20)]), at[1])
            keep, step = own[at], 1e-6
            own[at] = keep + step
            up = loss()
            own[at] = keep - step
            down = loss()
            own[at] = keep
            assert abs((up - down) / (2 * step) - g[at]) < 1e-5, (name, at)


def test_samples_fill_rare_labels_first(spark):
    sizes = {f"l{k}": 3000 for k in range(11)} | {"rare": 330, "tiny": 7}
    rows_ = [(i, k) for k, n in sizes.items() for i in [f"{k}-{j}" for j in range(n)]]
    df = spark.createDataFrame(rows_, "id string, label string")
    got = dict(map(tuple, sample_by_label(df, "label", "id", 1500, 4000).groupBy("label").count().collect()))
    assert sum(got.values()) <= 4000 and got["tiny"] == 7 and got["rare"] > 0.8 * 320
    even = [got[f"l{k}"] for k in range(11)]
    assert min(even) > 0.75 * max(even)
    two = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(40_000)], "id int, label int")
    got = dict(map(tuple, sample_by_label(two, "label", "id", 3000, 600).groupBy("label").count().collect()))
    assert got[1] > 250 and got[0] + got[1] <= 600
    assert sample_by_label(df.limit(0), "label", "id", 10, 10).count() == 0


def test_rare_languages_and_rare_toxicity_are_learned(spark):
    r = np.random.default_rng(5)
    names = [f"lang{k}" for k in range(12)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {n: ["".join(r.choice(list(letters), 4)) for _ in range(60)] for n in names}
    rows_ = []
    for n in names:
        for _ in range(12 if n == "lang11" else 109):
            rows_.append((len(rows_), " ".join(r.choice(stems[n], 40)), n, 0))
    for k in range(0, len(rows_), 40):  # a sentence in 2.5 % of the documents, in whatever language
        i, t, n, _ = rows_[k]
        rows_[k] = (i, f"{t}. zzyx qqov {' '.join(r.choice(stems[n], 3))}. {t}", n, 1)
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, toxic int")
    found = L.predict(df.drop("lang"), L.fit(df, per_language=60, most=500)).collect()
    right = {n: [] for n in names}
    for row, (i, _, n, _) in zip(sorted(found, key=lambda x: x["doc_id"]), rows_):
        if zlib.crc32(str(i).encode()) % 4 == 2:
            right[n].append(row["lang_pred"] == n)
    assert np.mean(sum(right.values(), [])) > 0.95 and np.mean(right["lang11"]) >= 0.5
    scored = {x["doc_id"]: x["score"] for x in T.score(df.select("doc_id", "text"), T.fit(df.drop("toxic"), df.select("doc_id", "toxic"), per_label=300, most=400)).collect()}
    held = [(scored[i], y) for i, _, _, y in rows_ if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([s >= T.THRESHOLD for s, y in held if y]) >= 0.8 and np.mean([s >= T.THRESHOLD for s, y in held if not y]) < 0.03


def mixed(spark, data, **kw):
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    return df, X.mix(df, **kw).collect()


def test_mix_meets_its_budgets(spark):
    data = [(i, "w " * (i % 7), s, "z") for i in range(300) for s in ("a", "b", "c", None)] + [(1, "w w", "tiny", None), (1, "w w", "tiny", None), (2, None, "none", None), (3, "", "none", None)]
    df, got = mixed(spark, data)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert len(got) == len(data)
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6
    for rows_ in by.values():
        assert sum(r["taken"] for r in rows_) == int(rows_[0]["target"]) and rows_[0]["target"] <= 3 * rows_[0]["source_size"]
    assert by["tiny"][0]["target"] == 12 and by["none"][0]["target"] == 0
    # what is not capped shares by weight: a, b, c, none, tiny, null -> 5, 2, 1, 5, 2, 1
    assert abs(by["b"][0]["target"] / by["c"][0]["target"] - 2) < 1e-9
    again = {(r["doc_id"], r["source"], r["taken"]) for r in X.mix(df.orderBy(F.rand(3)).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["source"], r["taken"]) for r in got}
    assert mixed(spark, [(0, "a", "s", None)])[1][0]["taken"] == 1
    assert X.mix(df.limit(0)).count() == 0


def test_mix_of_many_rows_without_an_id(spark):
    data = [(None if k % 3 else k % 50, "w " * (1 + k % 4), "a" if k % 5 else "b", None) for k in range(3000)] + [(None, "w w w", "c", None)] * 500
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string").repartition(6)
    got = X.mix(df).collect()
    assert len(got) == len(data)
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        ordered = sorted((hashlib.md5(f"mix:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["doc_id"] is not None, r["size"], -r["part"]) for r in own)
        rest = int(own[0]["target"]) - own[0]["epochs"] * own[0]["source_size"]
        for _, _, size, part in ordered:
            assert -part == min(size, max(rest, 0))
            rest -= size
    assert sorted((str(r["doc_id"]), r["source"], r["taken"]) for r in X.mix(df.repartition(3)).collect()) == sorted((str(r["doc_id"]), r["source"], r["taken"]) for r in got)


def test_taking_the_mix(spark):
    data = [(i, f" one two\tthree {i} ", "a" if i % 3 else "b", 99) for i in range(40)] + [(77, None, "a", 0), (78, "x y", "a", 3), (78, "x y", "a", 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit("z") for c in ("size", "part", "epochs", "taken", "target")})
    plan = {}
    for r in X.mix(df).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"]
    taken = X.take(df)
    assert taken.columns == df.columns
    got = {}
    for r in taken.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["text"] in {d[1] for d in data} or (r["n_chars"] == len(r["text"]) and next(d[1] for d in data if d[0] == r["doc_id"]).startswith(r["text"]))
    assert got == {k: v for k, v in plan.items() if v}


def test_sql_expressible_queries_match_their_oracles(spark):
    for name, sql in queries.ORACLES.items():
        assert rows(queries.QUERIES[name](spark, SF).toArrow()) == rows(connect(SF).sql(sql).to_arrow_table()), name
