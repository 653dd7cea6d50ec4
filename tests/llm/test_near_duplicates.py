import random
from collections import defaultdict

import numpy as np
import xxhash

from millrace.llm import decontamination as D
from millrace.llm import simhash_dedup as S
from millrace.llm import substring_dedup as P
from millrace.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, most=2):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = list(prints.items())
    for i, (a, fa) in enumerate(items):
        for b, fb in items[i + 1 :]:
            if (fa ^ fb).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in prints}


def test_simhash_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {k: brute_fingerprint(t) for k, t in rows.items()}
    got = S.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)


def test_links_hold_all_pairs_within_two_bits(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = {0, (1 << 64) - 1, *base}
    for b in base:  # crowded neighbourhoods, chains, and bits in either half
        prints |= {b ^ (1 << i) for i in range(0, 64, 3)} | {b ^ (1 << i) ^ (1 << j) for i in range(0, 64, 9) for j in range(i + 1, 64, 11)} | {b ^ 0b111 << 20, b ^ 0b11111 << 30}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    for most in (0, 1, 2):
        parts = {r["node"]: r["component"] for r in connected_components(S.links(spark.createDataFrame(signed, "fp long"), most)).collect()}
        want = brute_components(dict(zip(sorted(prints), sorted(prints))), most)
        groups, own = defaultdict(set), defaultdict(set)
        for x, in signed:
            groups[parts.get(x, x)].add(x % (1 << 64))
        for x, c in want.items():
            own[c].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_simhash_edges(spark):
    rows = [(3, None, 1), (1, "", 1), (2, "one two", 1), (7, "ONE  two", 1), (None, "one two", 1), (9, "w " * 30_000, 1), (9, "w " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (2, 2), (7, 2), (None, 2), (9, 9), (9, 9)], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = S.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 9]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 150)] + [(1, 1), (5, 3), (3, 5), (200, 150), (None, 4)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 151)}, 200: 100, 3: 3, 5: 3}


def brute_tiles(a, b, least):
    fa, fb, out = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        for k in range(n):
            fa[i + k] = fb[j + k] = False
        out += n


def test_tiles_cover_as_much_as_the_plain_search():
    r = random.Random(2)
    for _ in range(150):
        a, b = ([r.randint(1, 5) for _ in range(r.randint(0, n))] for n in (25, 35))
        got = D.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3, 8)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        assert sum(n for _, _, n in got) == brute_tiles(a, b, 3)


BENCH = "item_id long, text string, doc_id int"
ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], BENCH)
    return {(r["doc_id"], r["item_id"]): r["coverage"] for r in D.find_leaks(d, b, **options).collect()}


def test_leaks_found_and_left(spark):
    w = ITEM[:-1].lower().split()
    moved = " ".join(w[10:]) + " padding words here " + " ".join(w[:10])
    docs = [f"x {ITEM} y", moved, " ".join(w[:15]), " ".join(w[:16]), None, "", "short one", "clean text " * 5000, ITEM.upper()]
    items = [ITEM, "short one", None, "", "..."]
    want = {(0, 0): 1.0, (1, 0): 1.0, (3, 0): 0.8, (6, 1): 1.0, (8, 0): 1.0}
    assert leaks(spark, docs, items) == want
    assert leaks(spark, docs, items, most_seed_bytes=0) == want
    assert leaks(spark, docs, []) == {} and leaks(spark, [], items) == {}


def test_leaks_on_a_table_both_ways(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = ({tuple(r) for r in D.find_leaks(docs, bench, most_seed_bytes=n).collect()} for n in (1 << 26, 0))
    assert a == b and a
    kept = D.remove_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {r[0] for r in a}


def test_compact_windows_are_the_cartesian_tree():
    r = random.Random(3)
    for _ in range(200):
        sizes = [r.randint(0, 30) for _ in range(3)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        sh, least = np.array([r.randint(0, 25) for _ in range(bounds[-1])], np.uint64), r.randint(2, 12)
        c, left, right, _ = P.compact_windows(sh, bounds, P._SEEDS[0], least)
        low = (1 << P._PLACE_BITS) - 1
        v = [int(x) & ~low | i for i, x in enumerate(P.mix(sh * np.uint64(P._SEEDS[0])))]
        want = set()
        for s, e in zip(bounds[:-1], bounds[1:]):
            for i in range(s, e):
                a, z = i, i
                while a > s and v[a - 1] > v[i]:
                    a -= 1
                while z < e - 1 and v[z + 1] > v[i]:
                    z += 1
                if z - a + 1 >= least:
                    want.add((i, a, z))
        assert want == set(zip(c.tolist(), left.tolist(), right.tolist()))


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_passages(spark):
    r = random.Random(9)
    shared, near, short = words(r, 60), words(r, 200).split(), words(r, 40)
    edited = list(near)
    for k in (50, 120):
        edited[k] = "changed"
    texts = [f"{words(r, 70)} {shared} {words(r, 30)}", f"{shared} {words(r, 90)}", " ".join(near), " ".join(edited), f"{short} {words(r, 60)}", f"{words(r, 60)} {short}", words(r, 300), None, "", words(r, 49)]
    same = words(r, 80)
    rows = list(enumerate(texts)) + [(20, same), (21, same), (22, same), (30, words(r, 55))] + [(31, "q " * 3000), (31, "q " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = P.repeated_passages(df)
    pairs = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in found.collect()}
    assert pairs >= {(0, 1), (2, 3)} and {x for p in pairs for x in p} == {0, 1, 2, 3, 20, 21, 22}
    hit = next(r for r in found.collect() if {r["doc_id"], r["other_id"]} == {0, 1})
    assert {hit["first_word"], hit["other_first"]} == {70, 0} and hit["n_words"] == 60 and hit["similarity"] == 1.0
    docs = {r["doc_id"]: (r["class_id"], r["n_words"]) for r in P.duplicate_documents(found).collect()}
    assert docs[0] == (0, 60) and docs[3][0] == 2 and docs[22] == (20, 80)
    assert P.duplicate_documents(P.repeated_passages(df.limit(0))).count() == 0


def near_passage(a, b, least=46, similarity=0.8):
    """Whether stretches of exactly `least` shingles at one of the shifts that shared shingles have are that similar."""
    at = defaultdict(list)
    for j, x in enumerate(b):
        at[x].append(j)
    shifts = {j - i for i, x in enumerate(a) for j in at.get(x, ())}
    for i in range(len(a) - least + 1):
        own = set(a[i : i + least])
        if len(own & at.keys()) < similarity * len(own):
            continue
        for j in (i + d for d in shifts):
            if 0 <= j <= len(b) - least:
                other = set(b[j : j + least])
                both = len(own & other)
                if both >= similarity * (len(own) + len(other) - both):
                    return True
    return False


def test_passages_on_a_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {d["doc_id"]: (d["text"] or "").encode().lower().split() for d in docs.collect()}
    shingles = {k: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] for k, w in texts.items()}
    exact, holders = defaultdict(set), defaultdict(set)
    for k, w in texts.items():
        for i in range(len(w) - 49):
            exact[tuple(w[i : i + 50])].add(k)
        for x in set(shingles[k]):
            holders[x].add(k)
    want = set().union(*(s for s in exact.values() if len(s) > 1))
    met = defaultdict(int)
    for s in holders.values():
        for x in s:
            for y in s:
                met[x, y] += x < y
    near = {k for (x, y), n in met.items() if n >= 37 and near_passage(shingles[x], shingles[y]) for k in (x, y)}
    found = P.repeated_passages(docs)
    got = {r["doc_id"] for r in P.duplicate_documents(found).collect()}
    assert want <= got and len(near & got) >= 0.95 * len(near)
    for r in found.collect():
        one, two = (texts[r[k]][r[a] : r[a] + r[n]] for k, a, n in (("doc_id", "first_word", "n_words"), ("other_id", "other_first", "other_words")))
        assert len(one) == r["n_words"] >= 50 and len(two) == r["other_words"] >= 50
        assert abs(jaccard(" ".join(map(repr, one)), " ".join(map(repr, two))) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8


def classes(spark, texts):
    found = P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r["doc_id"]: r["class_id"] for r in P.duplicate_documents(found).collect()}


def jaccard(a, b):
    x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_passages_made_of_frequent_lines_meet(spark):
    r = random.Random(5)
    lines = [words(r, 12) for _ in range(4)]
    shared = [" ".join(f"{line} {words(r, 1)}" for line in r.sample(lines, 4)) for _ in range(12)]
    texts = [f"{words(r, 30)} {p} {words(r, 30)}" for p in shared for _ in range(2)]
    texts += [" ".join(f"{words(r, 25)} {line}" for line in r.sample(lines, 4)) for _ in range(60)]
    assert classes(spark, texts) == {k: k - k % 2 for k in range(24)}


def test_a_drifting_family_is_one_class(spark):
    r = random.Random(6)
    now, family = words(r, 90).split(), []
    for k in range(30):
        now[(k * 37) % 90] = words(r, 1)
        family.append(" ".join(now))
    pairs = [(a, b) for a in range(30) for b in range(a) if jaccard(family[a], family[b]) >= 0.8]
    want = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(want) == 30 and classes(spark, family) == {x["node"]: x["component"] for x in want}


def test_a_phrase_before_an_exact_passage_in_the_lead():
    a = list(range(100, 160))
    b = [*range(500, 520), *a[30:35], *range(600, 615), *a, *range(700, 720)]
    a, b = (P.shingle_hashes(np.array(x, np.uint64)) for x in (a, b))
    assert P.passages(a, b, [(0, len(a) - 1, 0, len(b) - 1)]) == [(0, 60, 40, 60, 1.0)]


def test_passages_whose_shingles_stand_many_times_elsewhere(spark):
    """Every five-word shingle of the passages also stands k times by itself, on one side or on both."""
    r = random.Random(31)
    a, second = list(range(100, 160)), list(range(300, 370))
    for k in (1, 63, 64, 65, 200):
        noise = [x for _ in range(k) for own in (a, second) for i in r.sample(range(len(own) - 4), len(own) - 4) for x in (*own[i : i + 5], r.randint(10_000, 1 << 40))]
        b = [*noise, *a, *range(6000, 6040), *second, 10]
        for left, want in (([1, 2, *a, 3], {2}), ([*second, *range(5000, 5040), *a], {0, 110})):
            x, y = (P.shingle_hashes(np.array(t, np.uint64)) for t in (left, b))
            got = P.passages(x, y, [(0, len(x) - 1, 0, len(y) - 1)])
            assert {f[0] for f in got} == want and all(f[4] == 1 for f in got)
            assert [f[2] for f in got] == sorted((f[2] for f in got), reverse=len(want) > 1)
        x, y = (P.shingle_hashes(np.array(t, np.uint64)) for t in ([*noise[: 60 * k], *a, 11], [*noise[-60 * k :], 12, *a]))
        assert any(n >= 60 and score >= 0.8 for _, n, _, _, score in P.passages(x, y, [(0, len(x) - 1, 0, len(y) - 1)]))

    def repeats(own, k):
        return " ".join(f"{' '.join(own[i : i + 5])} {words(r, 2)}" for _ in range(k) for i in range(0, 56))

    texts, want = [words(r, 90)], {}
    for k in (63, 64, 70):
        for both in (False, True):
            own = words(r, 60).split()
            want |= dict.fromkeys((len(texts), len(texts) + 1), len(texts))
            texts += [f"{repeats(own, k)} {' '.join(own)}", f"{repeats(own, k) if both else ''} {words(r, 20)} {' '.join(own)} {words(r, 9)}"]
    assert classes(spark, texts) == want


def test_passages_of_repeated_units():
    for unit in (1, 3, 7, 60):
        for x, y in ((20, 100), (100, 20), (90, 90)):
            a, b = (P.shingle_hashes(np.array([9] + list(range(100, 100 + unit)) * (-(-60 // unit) + n) + [8 + n], np.uint64)) for n in (x, y))
            assert P.passages(a, b, [(0, len(a) - 1, 0, len(b) - 1)]), (unit, x, y)


def test_a_passage_before_a_more_edited_stretch():
    a = list(range(100, 280))
    b = list(a)
    for k in (40, *range(84, 180, 8)):
        b[k] = 1000 + k
    a, b = (P.shingle_hashes(np.array(x, np.uint64)) for x in (a, b))
    (start, n, other, m, score), = P.passages(a, b, [(0, len(a) - 1, 0, len(b) - 1)])
    assert start == other == 0 and n == m >= 80 and score >= 0.8


def test_clusters_of_one_word_variants(spark):
    """Passages of 60 words and their variants with one changed word each: variants resemble the original, few each other."""
    r = random.Random(8)
    texts, want = [], {}
    for size in (3, 6, 12, 24, 60):
        for _ in range(6):
            base = words(r, 60).split()
            family = []
            for k in range(size):
                own = list(base)
                if k:
                    own[r.randrange(5, 55)] = words(r, 1)
                family.append(" ".join(own))
            r.shuffle(family)
            lead = len(texts)
            for t in family:
                want[len(texts)] = lead
                texts.append(f"{words(r, r.randint(0, 80))} {t} {words(r, r.randint(0, 80))}")
    got = classes(spark, texts)
    assert all(want[k] == c for k, c in got.items())  # no class reaches into another
    assert len(got) >= 0.95 * len(want)


def test_frequent_lines_alone_make_no_class_and_no_square(spark):
    r = random.Random(12)
    line = words(r, 40)  # 36 of the 46 shingles of a passage: under the similarity with any text around it
    texts = [f"{words(r, 40)} {line} {words(r, 40)}" for _ in range(150)]
    texts += [f"{words(r, 20)} {line} {p} {words(r, 20)}" for p in (words(r, 30), words(r, 30)) for _ in range(2)]
    assert classes(spark, texts) == {150: 150, 151: 150, 152: 152, 153: 152}


def test_passages_of_very_long_texts(spark):
    r = random.Random(13)
    shared = words(r, 80)
    long_ones = [f"{words(r, 30_000)} {shared} {words(r, 10_000)}", f"{words(r, 5)} {shared}", "line of words that repeats " * 20_000, "line of words that repeats " * 15_000]
    assert classes(spark, long_ones) == {0: 0, 1: 0, 2: 2, 3: 2}


def test_a_passage_in_another_order_of_sentences_and_twice_in_one_text():
    r = random.Random(14)
    a, b = (list(range(k, k + 40)) for k in (1000, 2000))
    one, two = a + b, b + a
    x, y = (P.shingle_hashes(np.array(t, np.uint64)) for t in (one, two))
    assert P.passages(x, y, [(0, len(x) - 1, 0, len(y) - 1)])[0][4] >= 0.8
    z = P.shingle_hashes(np.array([*one, *(r.randint(5000, 9000) for _ in range(60)), *one], np.uint64))
    assert {f[0] for f in P.passages(z, x, [(0, len(z) - 1, 0, len(x) - 1)])} == {0, 140}


def brute_coverage(item, doc):
    """Share of an item's words that greedy tiles hold; short items are found only as a whole run."""
    size = min(5, len(item))
    return brute_tiles(item, doc, size) / len(item)


def test_leaks_against_brute_force(spark):
    r = random.Random(21)
    items = ["alpha " * 60, " ".join(["alpha beta gamma delta"] * 12), *(" ".join(r.choice("abc") for _ in range(r.randint(1, 24))) for _ in range(12))]
    docs = ["alpha " * 60, "alpha " * 47, "alpha " * 48, items[1] + " tail", *(" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(25))]
    docs += [" ".join([*t.split()[len(t.split()) // 2 :], "zzz", *t.split()[: len(t.split()) // 2]]) for t in items[2:8]]
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            c = brute_coverage(t.split(), d.split())
            if c >= 0.8 - 1e-9:
                want[i, j] = round(c, 9)
    assert (0, 0) in want and (1, 0) not in want and (2, 0) in want
    for most in (1 << 26, 0):
        assert {k: round(c, 9) for k, c in leaks(spark, docs, items, most_seed_bytes=most).items()} == want


def test_leaks_on_a_table_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r["item_id"]: D.words_of(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        w = D.words_of(r["text"])
        runs = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for item, own in items.items():
            held = [tuple(own[k : k + 5]) in runs for k in range(len(own) - 4)]
            reach = sum(any(held[max(0, p - 4) : p + 1]) for p in range(len(own)))
            if reach >= 0.8 * len(own) and len(own) > 4:
                places = [k for k in range(len(w) - 4) if tuple(w[k : k + 5]) in {tuple(own[j : j + 5]) for j in range(len(own) - 4)}]
                keep = sorted({p + d for p in places for d in range(5)})
                b = [x for a, p in zip([None, *keep], keep) for x in ([object()] if a is not None and p > a + 1 else []) + [w[p]]]
                if brute_coverage(own, b) >= 0.8 - 1e-9:
                    want.add((r["doc_id"], item))
    assert want and {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()} == want


def test_pairs_that_cannot_match_are_not_aligned(monkeypatch):
    """A pair is left before its shingles are placed if no stretch can be similar enough; that drops no passage."""
    placed = []
    places = P._places
    monkeypatch.setattr(P, "_places", lambda *args: (placed.append(1), places(*args))[1])
    r = random.Random(11)
    base = [r.getrandbits(40) for _ in range(200)]
    far = [w if k % 9 else r.getrandbits(40) for k, w in enumerate(base)]
    shingles = lambda words: P.shingle_hashes(np.array(words, np.uint64))
    assert P.passages(shingles(base), shingles(far), [(0, 195, 0, 195)]) == [] and not placed
    both, found = [], 0
    for seed in range(150):
        r = random.Random(seed)
        unit = [r.getrandbits(40) for _ in range(r.choice([7, 60, 160]))]
        one = (unit * 9)[:160]
        two = [w for w in one if r.random() > 0.01]
        for _ in range(r.choice([1, 2, 4, 8])):
            two.insert(r.randrange(len(two)), r.getrandbits(40))
        both.append((shingles(one), shingles(two)))
    with_test = [P.passages(a, b, [(0, len(a) - 1, 0, len(b) - 1)]) for a, b in both]
    monkeypatch.setattr(P, "_may_match", lambda *args: True)
    assert [P.passages(a, b, [(0, len(a) - 1, 0, len(b) - 1)]) for a, b in both] == with_test
    assert 30 < sum(map(bool, with_test)) < 150


def test_a_pair_of_many_finer_groups_is_one_row(spark):
    rows = spark.createDataFrame([(two, uid, uid, 10 * two + uid, 10 * two + uid + 60) for two in range(20) for uid in (1, 2, 3)], "two long, uid long, part long, l int, r int")
    found = {(x.uid, x.lead): [tuple(y) for y in x.regions] for x in P._cross(rows, rows, True).collect()}
    assert found == {(a, b): [(a, 250 + a, b, 250 + b)] for a, b in ((1, 2), (1, 3), (2, 3))}
