"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (a run of `minimum` words) are compared by running Karp-Rabin
greedy string tiling: the longest matches between words not yet covered are marked first, until none of
`minimum` words is left. An item is found in a document if tiles cover at least `coverage` of its words, in
whatever order they stand there.

As each tile is a run of seeds, an item can be covered that far only if its places at which a seed of the
document begins reach over as many of its words, which is tested before tiling; and only the places of a document
where seeds stand are tiled. Where the benchmark's
seeds are few enough (their number is counted first), they go to the tasks that read the documents and no
document is shuffled. Beyond that, seeds and documents meet in an equality join.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import carried, materialize, pick

MINIMUM, COVERAGE = 5, 0.8
_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_MEMO_ENTRIES = 500_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class WordHashes(dict):
    """64-bit hashes of words that have been met, never 0; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMO_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 9) or 1
        return h


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Rolling hash of each run of `length` words."""
    n = len(hashes) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(length if n > 0 else 0):
        out *= np.uint64(_BASE)
        out += hashes[k : k + n]
    return out


def tiles(a: np.ndarray, b: np.ndarray, minimum: int = MINIMUM, first: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes by running Karp-Rabin: (place in a, place in b, length).

    Words hashed 0 match nothing. Of equally long matches the one first in a, then in b, is marked.
    """
    a_free, b_free = a != 0, b != 0
    xs, ys = a.tolist(), b.tolist()
    found: list[tuple[int, int, int]] = []
    length = max(minimum, min(first, len(a)))
    while True:
        matches = _matches(xs, ys, a_free, b_free, length)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        by_length = defaultdict(list)
        for i, j, n in matches:
            by_length[n].append((i, j))
        while by_length:
            n = max(by_length)
            for i, j in sorted(by_length.pop(n)):
                free = (a_free[i : i + n] & b_free[j : j + n]).tolist()
                if all(free):
                    a_free[i : i + n] = b_free[j : j + n] = False
                    found.append((i, j, n))
                    continue
                start = 0
                for k, open_ in enumerate([*free, False]):  # what is left of the match may still be long enough
                    if not open_:
                        if length <= k - start < n:
                            by_length[k - start].append((i + start, j + start))
                        start = k + 1
        if length == minimum:
            return sorted(found)
        length = max(minimum, length // 2)


def _windows(xs: list[int], free: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """(hash, place) of the runs of `length` free words, rolled along each free stretch."""
    top = pow(_BASE, length, 1 << 64)
    h = n = 0
    for k, (x, open_) in enumerate(zip(xs, free.tolist())):
        if not open_:
            h = n = 0
            continue
        h, n = (h * _BASE + x) & _MASK, n + 1
        if n > length:
            h = (h - xs[k - length] * top) & _MASK
        if n >= length:
            yield h, k - length + 1


def _matches(xs: list[int], ys: list[int], a_free: np.ndarray, b_free: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of free words, `length` or longer."""
    at = defaultdict(list)
    for h, j in _windows(ys, b_free, length):
        at[h].append(j)
    af, bf, out = a_free.tolist(), b_free.tolist(), []
    for h, i in _windows(xs, a_free, length):
        for j in at.get(h, ()):
            if i and j and af[i - 1] and bf[j - 1] and xs[i - 1] == ys[j - 1]:
                continue  # part of a match that started earlier
            n = 0
            while i + n < len(xs) and j + n < len(ys) and af[i + n] and bf[j + n] and xs[i + n] == ys[j + n]:
                n += 1
            if n >= length:
                out.append((i, j, n))
    return out


class Benchmark:
    """Items with their words' hashes and seeds."""

    def __init__(self, items: list[tuple[int, str | None]], minimum: int, coverage: float):
        self.hashes, self.coverage, self.minimum = WordHashes(), coverage, minimum
        self.ids, self.words, self.own_seeds = [], [], []
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            own = words_of(text)
            if not own:
                continue
            h = np.array([self.hashes[w] for w in own], np.uint64)
            size = min(minimum, len(own))
            own_seeds = runs(h, size)
            for r in own_seeds.tolist():
                seeds[size][r].add(len(self.ids))
            self.ids.append(item_id)
            self.words.append(h)
            self.own_seeds.append(own_seeds)
        self.vocabulary = dict(self.hashes)
        self.seeds = {size: (np.array(sorted(s), np.uint64), [sorted(s[k]) for k in sorted(s)]) for size, s in seeds.items()}

    def search(self, words: list[str]) -> list[tuple]:
        """(item id, coverage, matched words, tiles, first word, last word) of each item that is found."""
        h = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        known = h != 0
        out = []
        for size, (seeds, items) in self.seeds.items():
            if len(h) < size:
                continue
            reach = np.concatenate([[0], np.cumsum(known)])
            start = np.flatnonzero(reach[size:] - reach[:-size] == size)
            if not len(start):
                continue
            r = np.zeros(len(start), np.uint64)
            for k in range(size):
                r = r * np.uint64(_BASE) + h[start + k]
            at = np.searchsorted(seeds, r)
            hit = seeds[np.minimum(at, len(seeds) - 1)] == r
            start, at = start[hit], at[hit]
            places = defaultdict(list)
            for p, s in zip(start.tolist(), at.tolist()):
                for item in items[s]:
                    places[item].append((p, s))
            for item, seen in places.items():
                a = self.words[item]
                if self._reach(item, seeds[sorted({s for _, s in seen})], size) < self.coverage * len(a) - 1e-9:
                    continue
                found = self.compare(a, h, [p for p, _ in seen], size)
                if found:
                    out.append((self.ids[item], *found))
        return out

    def _reach(self, item: int, seeds: np.ndarray, size: int) -> int:
        """How many of an item's words its places with these seeds hold: no tiling can cover more."""
        edges = np.zeros(len(self.words[item]) + 1, np.int64)
        at = np.flatnonzero(np.isin(self.own_seeds[item], seeds))
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
        return int((np.cumsum(edges) > 0).sum())

    def compare(self, a: np.ndarray, h: np.ndarray, starts: list[int], size: int) -> tuple | None:
        keep = np.zeros(len(h) + 1, bool)
        for p in starts:
            keep[p : p + size] = True
        places = np.flatnonzero(keep[:-1])
        # what is left out becomes one word that matches nothing
        gaps = np.flatnonzero(np.diff(places) > 1) + 1
        b = np.insert(h[places], gaps, 0)
        where = np.insert(places, gaps, -1)
        got = tiles(a, b, size)
        matched = sum(n for _, _, n in got)
        if matched < self.coverage * len(a) - 1e-9:
            return None
        return matched / len(a), matched, len(got), int(min(where[j] for _, j, _ in got)), int(max(where[j + n - 1] for _, j, n in got))


_DDL = "doc_id long, item_id long, coverage double, matched_words int, n_tiles int, first_word int, last_word int"
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
_NAMES = [c.split()[0] for c in _DDL.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_NAMES)


def _search(benchmark: Benchmark):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                rows += [(doc_id.as_py(), *found) for found in benchmark.search(words_of(text.as_py()))]
            yield _batch(rows)

    return search


def _seed_rows(sizes: tuple[int, ...], minimum: int, own_size: bool):
    """(row, size, seed, times, n_words) for a text: its seeds of its own size (items) or of all sizes (documents)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                h = np.array([hashes[w] for w in words], np.uint64)
                for size in (min(minimum, len(words)),) if own_size else sizes:
                    r, times = np.unique(runs(h, size), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), row)), pa.array(np.full(len(r), size, np.int32)), pa.array(r.view(np.int64)), pa.array(times.astype(np.int32)), pa.array(np.full(len(r), len(words), np.int32))], names=["row", "size", "seed", "times", "n_words"])

    return emit


def _compare_pairs(minimum: int, coverage: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, item_id, text, item in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(doc_id, *found) for found in Benchmark([(item_id, item)], minimum, coverage).search(words_of(text))]
            yield _batch(rows)

    return compare


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", minimum: int = MINIMUM, coverage: float = COVERAGE, most_seed_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, coverage, matched_words, n_tiles, first_word, last_word), a row for each item found in a
    document's whole text.

    Words are runs of letters, digits and underscores in lower case. An item with fewer words than `minimum`
    is found only as a whole run; one without words never. Null and empty texts hold nothing. Each row of docs
    and of benchmark counts, repeated ones too. An empty table on either side gives an empty result.

    most_seed_bytes bounds the item text that is sent to the tasks (about 30 bytes of seeds for each of its
    bytes); a larger benchmark takes the join.
    """
    items = pick(benchmark, item_id=item_col, item=item_text_col).select(F.col("item_id").cast("long"), "item")
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    if size * 30 <= most_seed_bytes:
        got = items.toArrow()
        return texts.mapInArrow(_search(Benchmark(list(zip(*(c.to_pylist() for c in got.columns))), minimum, coverage)), _DDL)
    return _find_by_join(texts, items, minimum, coverage)


def _find_by_join(texts: DataFrame, items: DataFrame, minimum: int, coverage: float) -> DataFrame:
    ddl = "row long, size int, seed long, times int, n_words int"
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "leak-docs")
    items = materialize(items.withColumn("item_row", F.monotonically_increasing_id()), "leak-items")
    item_seeds = items.select("item_row", "item").mapInArrow(_seed_rows((), minimum, True), ddl).withColumnRenamed("row", "item_row")
    item_seeds = materialize(item_seeds, "leak-seeds")
    sizes = tuple(r[0] for r in item_seeds.select("size").distinct().orderBy("size").collect())  # at most `minimum` of them
    doc_seeds = texts.select("row", "text").mapInArrow(_seed_rows(sizes, minimum, False), ddl).drop("times", "n_words")
    shared = doc_seeds.join(item_seeds, ["size", "seed"]).groupBy("row", "item_row", "size", "n_words").agg(F.sum("times").alias("n"))
    # a place of an item with a shared seed holds `size` of its words at most
    pairs = shared.where(F.col("n") * F.col("size") >= F.lit(coverage) * F.col("n_words") - 1e-9).select("row", "item_row")
    both = pairs.join(texts, "row").join(items, "item_row").select("doc_id", "item_id", "text", "item")
    return both.mapInArrow(_compare_pairs(minimum, coverage), _DDL)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds an item; options are those of find_leaks. Rows that share an id are told
    apart by their text. Other columns are kept, whatever their names."""
    rows, at, back = carried(docs)
    marked = rows.withColumn("stamp", F.xxhash64(F.coalesce(at(id_col).cast("long").cast("string"), F.lit("null")), F.xxhash64(at(text_col))))
    found = find_leaks(marked.select(F.col("stamp").alias("doc_id"), at(text_col).alias("text")), benchmark, **options)
    bad = materialize(found.select(F.col("doc_id").alias("stamp")).distinct(), "leaks")
    return back(marked.join(bad.hint("shuffle_hash"), "stamp", "left_anti"))
