"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingles, and each of HASHES functions orders them by a hash. The Cartesian tree
of a text's hashes groups its subsequences by their minimum: node c with subtree [l, r] stands for all [i, j]
with l <= i <= c <= j <= r, whose min-hash is that of c. Only nodes whose subtree holds a passage of the least
length are kept, about 2 / length of all positions; they are exactly the minima of sliding windows of that
length, so they are found by numpy without building the whole tree, and the tree of the kept ones gives l and r.

Equal texts are one text from the start; copies are linked with the copy of the smallest id. Windows of different
texts with the same function and minimum meet in a grouping by that value. Every member of a group is compared with
its lead, the member whose surroundings the most texts share (of a family of edited copies the one nearest to all).
An interval join of a pair's windows gives the regions where those of at least AGREE functions overlap; passages
there are aligned by shingle hashes and their similarity is computed on the words themselves.

After that, a group is done if links connect all its members. The others are grouped again, by the minima of two
functions whose windows overlap, as a link needs two. In these finer groups members of different components are
compared if they can be linked at all: a passage of similarity s to another text has a share s of its shingles
there, so around the common minima a stretch of the least length must have that share of shingles that also occur
in another component. Texts that have but a frequent line or phrase in common fail this test. The rest is compared
with a new lead, the most shared member beyond the components of earlier leads, as long as that connects
components; then members of a finer group that are still in different components are compared with each other,
without a cap. So only texts that are patchworks of others, yet linked with none of them, meet in pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._hashing import BASE, mix, stretch_hashes
from millrace.llm._shared import materialize, pick
from millrace.llm.components import connected_components
from millrace.llm.mixing import word_count

SHINGLE, LEAST_WORDS, SIMILARITY = 5, 50, 0.8
HASHES, AGREE, ROUNDS = 4, 2, 3
_SEEDS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3]
_PLACE_BITS = 22
_CHUNK_BYTES = 1 << 19
_SEEN = 1 << 20
_KEPT = 1 << 21


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words (runs without ASCII white space) of bytes that are in lower case."""
    b = np.frombuffer(data, np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return stretch_hashes(b, starts, ends), starts


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out *= np.uint64(BASE)
        out += words[k : k + n]
    return mix(out)


def compact_windows(shingles: np.ndarray, bounds: np.ndarray, seed: int, least: int, bounded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r, text): the windows of texts whose shingles follow one another; bounds has where each begins, and the end.

    Of equal hashes the first is the smaller. l and r are places as c is, both included; unless bounded, they are not
    worked out.
    """
    none = np.zeros(0, np.int64)
    n = len(shingles)
    if n < least:
        return none, none, none, none
    low = np.uint64((1 << _PLACE_BITS) - 1)
    ordered = (mix(shingles * np.uint64(seed)) & ~low) | np.arange(n, dtype=np.uint64)
    m, width = ordered, 1
    while width * 2 <= least:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < least:
        m = np.minimum(m[: len(m) - (least - width)], m[least - width :])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[: n - least + 1] == text[least - 1 :]
    c = (m[whole] & low).astype(np.int64)
    if not len(c):
        return none, none, none, none
    c = c[np.concatenate([[True], c[1:] != c[:-1]])]
    if not bounded:
        return c, c, c, text[c]
    # the tree of the kept nodes: a node reaches to the nearest smaller one on each side, or to its text's ends
    values, texts = ordered[c].tolist(), text[c]
    left, right = bounds[texts].copy(), bounds[texts + 1] - 1
    stack: list[int] = []
    places, owner = c.tolist(), texts.tolist()
    last = -1
    for k, v in enumerate(values):
        if owner[k] != last:
            stack, last = [], owner[k]
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[k] - 1
        if stack:
            left[k] = places[stack[-1]] + 1
        stack.append(k)
    return c, left, right, texts


_WINDOWS = "key long, uid long, fn int, l int, c int, r int"


def _windows(least_words: int, hashes: int, bounded: bool):
    least = least_words - SHINGLE + 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies that a task meets again need no windows; emptied when full
        for batch in batches:
            uids, texts = batch.column(0).to_numpy(), batch.column(1)
            group: list[tuple[int, bytes]] = []
            size = 0
            for k in range(batch.num_rows):
                if uids[k] in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(uids[k])
                data = (texts[k].as_py() or "").encode("utf-8", "surrogatepass").lower()
                if len(data) >= 2 * least_words - 1:
                    group.append((uids[k], data))
                    size += len(data)
                if size >= _CHUNK_BYTES:
                    yield from _group_windows(group, least, hashes, bounded)
                    group, size = [], 0
            if group:
                yield from _group_windows(group, least, hashes, bounded)

    return make


def _group_windows(group: list[tuple[int, bytes]], least: int, hashes: int, bounded: bool) -> Iterator[pa.RecordBatch]:
    per_text = [shingle_hashes(word_hashes(data)[0]) for _, data in group] if len(group) == 1 else _many(group)
    uids = np.array([u for u, _ in group])
    sizes = np.array([len(s) for s in per_text])
    shingles = np.concatenate(per_text)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if len(shingles) >= 1 << _PLACE_BITS:  # a very long text: pieces that overlap by less than a passage lose none
        yield from _long_windows(per_text, uids, least, hashes, bounded)
        return
    for fn in range(hashes):
        c, left, right, text = compact_windows(shingles, bounds, _SEEDS[fn], least, bounded)
        if len(c):
            yield _rows(shingles[c], uids[text], fn, left - bounds[text], c - bounds[text], right - bounds[text])


def _many(group: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """Shingles of several texts, hashed in one go."""
    words, starts = word_hashes(b" ".join(d for _, d in group))
    ends = np.cumsum([len(d) + 1 for _, d in group])
    cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
    return [shingle_hashes(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _long_windows(per_text: list[np.ndarray], uids: np.ndarray, least: int, hashes: int, bounded: bool) -> Iterator[pa.RecordBatch]:
    step = (1 << _PLACE_BITS) - least
    for uid, own in zip(uids, per_text):
        for a in range(0, max(1, len(own) - least + 1), step):
            part = own[a : a + step + least - 1]
            for fn in range(hashes):
                c, left, right, _ = compact_windows(part, np.array([0, len(part)]), _SEEDS[fn], least, bounded)
                if len(c):
                    yield _rows(part[c], np.full(len(c), uid), fn, left + a, c + a, right + a)


def _rows(shingles: np.ndarray, uids: np.ndarray, fn: int, left: np.ndarray, c: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    keys = mix(shingles ^ np.uint64(_SEEDS[fn] >> 7)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(uids), pa.array(np.full(len(c), fn, np.int32)), *(pa.array(x.astype(np.int32)) for x in (left, c, right))], names=[f.split()[0] for f in _WINDOWS.split(", ")])


class Sorted:
    """A text's shingles in order of their hashes, to look up where those of others stand."""

    def __init__(self, shingles: np.ndarray):
        self.shingles = shingles
        self.order = np.argsort(shingles, kind="stable")
        ordered = shingles[self.order]
        self.begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        self.values = ordered[self.begins]
        self.counts = np.diff(np.append(self.begins, len(ordered)))
        # places ascend within a value, so value and place together ascend
        self.places = np.repeat(np.arange(len(self.values)), self.counts) * (len(shingles) + 1) + self.order

    def find(self, shingles: np.ndarray) -> np.ndarray:
        """The number of each shingle among the values, -1 if it is none."""
        if not len(self.values):
            return np.full(len(shingles), -1)
        at = np.minimum(np.searchsorted(self.values, shingles), len(self.values) - 1)
        return np.where(self.values[at] == shingles, at, -1)

    def nearest(self, value: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the places of each value the nearest to the target."""
        size = len(self.shingles)
        x = np.searchsorted(self.places, value * (size + 1) + np.clip(target, 0, size))
        last = self.begins[value] + self.counts[value] - 1
        before, after = self.order[np.clip(x - 1, self.begins[value], last)], self.order[np.clip(x, self.begins[value], last)]
        return np.where(np.abs(before - target) <= np.abs(after - target), before, after)


def passages(sa: np.ndarray, sb: np.ndarray | Sorted, regions: list[tuple[int, int, int, int]], least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(first word in a, words, first word in b, words, similarity) of the verified passages of two texts' shingles, in
    the regions (l and r in a, l and r in b) that joined windows span."""
    least = least_words - SHINGLE + 1
    b = sb if isinstance(sb, Sorted) else Sorted(sb)
    inside = np.zeros(len(sa) + 1, np.int64)
    for la, ra, _, _ in regions:
        inside[max(la, 0)] += 1
        inside[min(ra + 1, len(sa))] -= 1
    value = np.where(np.cumsum(inside)[:-1] > 0, b.find(sa), -1)
    hits = np.flatnonzero(value >= 0)
    if len(hits) < similarity * least or hits[-1] - hits[0] < least - 1:
        return []
    if not _may_match(sa, hits, similarity, least):
        return []
    at = _places(hits, value[hits], b)
    out, left, start = [], [], 0
    # runs with gaps that a change of two words leaves, as they are; then the whole, wherever its gaps are
    cuts = (np.flatnonzero(np.diff(hits) > 2 * SHINGLE) + 1).tolist()
    for s, e in zip([0, *cuts], [*cuts, len(hits)]):
        found = _compare(sa, b.shingles, hits[s:e], at[s:e], similarity, least)
        if found:
            out.append(found)
            left.append((start, s))
            start = e
    left.append((start, len(hits)))
    while left:
        s, e = left.pop()
        stretch = _longest_stretch(hits[s:e], at[s:e], similarity, least)
        if stretch is None:
            continue
        i, j = s + stretch[0], s + stretch[1]
        found = _compare(sa, b.shingles, hits[i:j], at[i:j], similarity, least)
        if found:
            out.append(found)
            left += [(s, i), (j, e)]
        else:  # apart where the alignment breaks most
            breaks = np.abs(np.diff(at[i:j]) - 1) + np.diff(hits[i:j]) - 1
            apart = (np.flatnonzero(breaks * 2 >= breaks.max(initial=1)) + i + 1).tolist() or [(i + j) // 2]
            left += [*zip([s, *apart], [*apart, e])]
    return sorted(out)


def _may_match(shingles: np.ndarray, hits: np.ndarray, similarity: float, least: int) -> bool:
    """Whether any stretch of the least length from hit to hit can be similar enough. Shingles in the stretch that are no hits
    are in one of the two sets alone; those that the text holds several times may be counted elsewhere."""
    first, n = hits[0], int(hits[-1] - hits[0]) + 1
    here = hits - first
    value = np.full(n, -similarity)
    value[here] = 1 - similarity

    def any_stretch() -> bool:
        ends = np.cumsum(value)
        begins = np.full(n, np.inf)
        begins[here] = ends[here] - (1 - similarity)
        lowest = np.minimum.accumulate(begins)
        last = here[here >= least - 1]
        return bool((lowest[last - (least - 1)] <= ends[last] + 1e-6).any())

    if any_stretch():
        return True
    _, number, times = np.unique(shingles, return_inverse=True, return_counts=True)
    several = times[number[first : first + n]] > 1
    if not several.any():
        return False
    value[several & (value < 0)] = 0
    return any_stretch()


def _longest_stretch(hits: np.ndarray, at: np.ndarray, similarity: float, least: int) -> tuple[int, int] | None:
    """(from, to) of the longest stretch of hits that may be similar enough: a hit adds 1 - similarity and a place missed
    on either side takes similarity, and the sum is not below 0."""
    if len(hits) < similarity * least or hits[-1] - hits[0] < least - 1:
        return None
    missed = np.diff(hits) - 1
    other = np.diff(at) - 1
    missed = missed + np.where((other >= 0) & (other <= 2 * SHINGLE + 2 * missed), other, missed)
    ends = np.cumsum(np.concatenate([[1 - similarity], 1 - similarity - similarity * missed]))
    begins = ends - (1 - similarity)  # what a stretch that begins here need not count
    lowest = np.minimum.accumulate(begins)
    # for each end the first place whose sum before it is low enough; of these the longest in words
    start = np.searchsorted(-lowest, -(ends + 1e-9))
    good = np.flatnonzero(start <= np.arange(len(hits)))
    if not len(good):
        return None
    spans = hits[good] - hits[start[good]] + 1
    k = int(spans.argmax())
    return (int(start[good[k]]), int(good[k]) + 1) if spans[k] >= least else None


def _places(hits: np.ndarray, value: np.ndarray, b: Sorted) -> np.ndarray:
    """Places in the other text of the shingles at `hits`.

    A shingle that stands there once has that place, and so has one that stands on the diagonal of the nearest such. Others
    take the place of the shortest run around them that the other text has once: runs are doubled in length, and
    all of their places are looked at, until each shingle has one or no run is shared any more. What is left, as in
    texts that repeat a unit, follows the nearest run that was placed, or one of the longest shared ones.
    """
    at = b.order[b.begins[value]]
    known = b.counts[value] == 1
    if known.all():
        return at
    at = at.copy()

    def along(shift: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Place the hits `left` near their shifts; which of them stand exactly there."""
        target = hits[left] + shift
        at[left] = b.nearest(value[left], target)
        return at[left] == target

    if known.any():
        left = np.flatnonzero(~known)
        known[left] = along(_nearest_shift(hits, at, known, left), left)
    first, n = hits[0], hits[-1] - hits[0] + 1
    ranks = np.full(n, -1)
    ranks[hits - first] = value
    others = np.empty(len(b.shingles), np.int64)
    others[b.order] = np.repeat(np.arange(len(b.values)), b.counts)
    run, longest = 1, None
    while not known.all() and run < min(len(ranks), len(others)):
        fit = np.flatnonzero((ranks[:-run] >= 0) & (ranks[run:] >= 0))
        theirs = np.flatnonzero((others[:-run] >= 0) & (others[run:] >= 0))
        size = max(ranks.max(), others.max()) + 1
        keys, other_keys = ranks[fit] * size + ranks[fit + run], others[theirs] * size + others[theirs + run]
        shared, times = np.unique(other_keys[np.isin(other_keys, keys)], return_counts=True)
        if not len(shared):
            break
        ranks, others = _renumbered(keys, fit, shared, len(ranks) - run), _renumbered(other_keys, theirs, shared, len(others) - run)
        run *= 2
        place = np.zeros(len(shared), np.int64)
        there = np.flatnonzero(others >= 0)[::-1]
        place[others[there]] = there  # the first of each
        starts = np.flatnonzero(ranks >= 0)
        longest = (int(starts[0]) + first, int(place[ranks[starts[0]]]))
        starts = starts[times[ranks[starts]] == 1]
        if len(starts):
            left = np.flatnonzero(~known)
            k = np.searchsorted(starts, hits[left] - first, "right") - 1
            covered = (k >= 0) & (starts[np.maximum(k, 0)] > hits[left] - first - run)
            left, k = left[covered], k[covered]
            at[left] = hits[left] + place[ranks[starts[k]]] - starts[k] - first
            known[left] = True
    left = np.flatnonzero(~known)
    if len(left):
        if known.any():
            along(_nearest_shift(hits, at, known, left), left)
        elif longest:
            along(np.full(len(left), longest[1] - longest[0]), left)
    return at


def _renumbered(keys: np.ndarray, where: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the number of its key among the shared ones, -1 for none."""
    k = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
    out = np.full(n, -1)
    out[where] = np.where(shared[k] == keys, k, -1)
    return out


def _nearest_shift(hits: np.ndarray, at: np.ndarray, known: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shift of the nearest hit whose place is known, for each hit of `left`."""
    placed = np.flatnonzero(known)
    k = np.searchsorted(placed, left)
    before, after = placed[np.maximum(k - 1, 0)], placed[np.minimum(k, len(placed) - 1)]
    near = np.where(np.abs(hits[left] - hits[before]) <= np.abs(hits[after] - hits[left]), before, after)
    return at[near] - hits[near]


def _compare(xa: np.ndarray, xb: np.ndarray, hits: np.ndarray, at: np.ndarray, similarity: float, least: int) -> tuple[int, int, int, int, float] | None:
    """(first word, words, first word in the other, words, similarity) of the stretch from the first hit to the last and
    the one that answers to it, if that is high enough."""
    i, j = int(hits[0]), int(hits[-1]) + 1
    if j - i < least:
        return None
    off = np.abs(at - hits - np.sort(at - hits)[len(hits) // 2])
    u = np.unique(xa[i:j])
    for reach in (j - i, 2 * (j - i)):  # stretches that stand in another order are further off
        near = at[off <= reach]
        p, q = int(near.min()), int(near.max()) + 1
        if q - p < least:
            continue
        v = np.unique(xb[p:q])
        both = len(np.intersect1d(u, v, assume_unique=True))
        score = both / (len(u) + len(v) - both)
        if score >= similarity:
            return i, j - i + SHINGLE - 1, p, q - p + SHINGLE - 1, score
    return None


def _clusters(pairs) -> list[tuple[set[int], int, int, int, int]]:
    """Interval join of the windows: those that overlap in a and in b, directly or through others, are taken together."""
    open_: list[list] = []
    done: list[list] = []
    for fn, l1, _, r1, l2, _, r2 in sorted(pairs, key=lambda x: x[1]):
        new = [{fn}, l1, r1, l2, r2]
        still = []
        for old in open_:
            if old[2] < l1:
                done.append(old)
            elif old[3] <= r2 and l2 <= old[4]:
                new = [new[0] | old[0], min(new[1], old[1]), max(new[2], old[2]), min(new[3], old[3]), max(new[4], old[4])]
            else:
                still.append(old)
        open_ = [*still, new]
    return [tuple(x) for x in done + open_]


def _word_similarity(a: list[bytes], b: list[bytes]) -> float:
    """Jaccard similarity of the shingles of two passages, by their words."""
    x, y = (set(zip(*(t[k:] for k in range(SHINGLE)))) for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


_REGIONS = "uid long, lead long, regions array<struct<la:int,ra:int,lb:int,rb:int>>"
_REGION = pa.list_(pa.struct([(k, pa.int32()) for k in ("la", "ra", "lb", "rb")]))


def _join_intervals(agree: int):
    """Pairs with lists of windows -> pairs with the regions where windows of at least `agree` functions overlap."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).offsets.to_numpy().tolist()
            values = [batch.column(2).values.field(k).to_numpy().tolist() for k in range(7)]
            windows = list(zip(*values))
            uids, leads, regions = [], [], []
            for k, (uid, lead) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                found = [{"la": la, "ra": ra, "lb": lb, "rb": rb} for fns, la, ra, lb, rb in _clusters(windows[at[k] : at[k + 1]]) if len(fns) >= agree]
                if found:
                    uids.append(uid)
                    leads.append(lead)
                    regions.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(leads, pa.int64()), pa.array(regions, _REGION)], names=["uid", "lead", "regions"])

    return join


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["uid", "packed"])


def _opened(packed: bytes) -> np.ndarray:
    """Shingle hashes of a packed text."""
    return shingle_hashes(word_hashes(zlib.decompress(packed).lower())[0])


def _words(packed: bytes) -> list[bytes]:
    return zlib.decompress(packed).lower().split()


_FOUND = "uid long, other_uid long, first_word int, n_words int, other_first int, other_words int, similarity double"
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _verify(least_words: int, similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()]
        last, b, other_words = None, None, None
        kept: dict[int, np.ndarray] = {}  # shingles of texts that the task opened; emptied when full
        held = 0
        for batch in batches:
            rows = []
            for uid, packed, other_uid, other, regions in zip(*(c.to_pylist() for c in batch.columns)):
                if other_uid != last:  # rows come sorted by it
                    last, b, other_words = other_uid, Sorted(_opened(other)), None
                a = kept.get(uid)
                if a is None:
                    a = _opened(packed)
                    if held + len(a) > _KEPT:
                        kept, held = {}, 0
                    kept[uid] = a
                    held += len(a)
                found = passages(a, b, [tuple(r.values()) for r in regions], least_words, similarity)
                if found:
                    words = _words(packed)
                    other_words = other_words or _words(other)
                for i, n, j, m, _ in found:
                    score = _word_similarity(words[i : i + n], other_words[j : j + m])
                    if score >= similarity:
                        rows.append((uid, other_uid, i, n, j, m, score))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=_FOUND_NAMES)

    return verify


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """(uid, doc_id, other_uid, other_id, first_word, n_words, other_first, other_words, similarity): passages of at
    least least_words words whose five-word shingles have a Jaccard similarity of at least `similarity`.

    Words are runs without ASCII white space, ASCII letters in lower case. Passages are found between different texts,
    each pair in the order of their uids (64-bit hashes of the texts), under the smallest ids of equal texts; every
    further id of a text of least_words words has one row with that smallest one, over the whole text. Rows that
    repeat both id and text are one document; null and short texts have no passages; a null id may be linked like
    any other, and comes last. An empty table gives an empty result. Links between texts that others connect already
    are not all listed.
    """
    picked = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("uid"), "text").where(F.octet_length("text") >= 2 * least_words - 1)
    windows = lambda bounded: picked.select("uid", "text").mapInArrow(_windows(least_words, hashes, bounded), _WINDOWS)
    # written, so that the join below has exchanges of its own, which AQE may split where a passage is very common
    ends = materialize(windows(False).groupBy("key").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"), "window-ends")
    # windows are worked out twice rather than stored: most of them meet no other
    shared = windows(True).join(ends.hint("shuffle_hash"), "key")
    reach = least_words - SHINGLE
    near = Window.partitionBy("uid").orderBy("c").rangeBetween(-reach, reach)
    shared = shared.repartition("uid").dropDuplicates(["uid", "key", "c"]).withColumn("weight", F.sum("n").over(near))
    members = shared.groupBy("uid", "key").agg(F.first("fn").alias("fn"), F.min("l").alias("l"), F.min("c").alias("c"), F.max("c").alias("c2"), F.max("r").alias("r"), F.max("weight").alias("weight"))
    members = materialize(members, "window-members")
    groups = members.groupBy("key").agg(F.count("*").alias("texts"), F.max(F.struct("weight", "uid"))["uid"].alias("lead")).where("texts > 1")
    groups = materialize(groups, "window-groups")
    placed = materialize(members.join(groups, "key"), "window-members")
    partners = placed.where(F.col("uid") == F.col("lead")).select("key", F.col("uid").alias("other"), *(F.col(k).alias(f"{k}_") for k in ("l", "c", "r")))
    led = _compared(picked, placed.where(F.col("uid") != F.col("lead")).join(partners, "key"), least_words, similarity, agree)
    found = _connected(picked, placed.where("texts > 2").drop("texts", "lead"), led, least_words, similarity, agree)
    return materialize(_with_ids(picked, found, least_words), "passages")


def _compared(picked: DataFrame, met: DataFrame, least_words: int, similarity: float, agree: int) -> DataFrame:
    """Verified passages of the pairs of windows met(uid, other, fn, l, c, r, l_, c_, r_)."""
    turned = F.col("uid") > F.col("other")
    own, other = [F.col(k) for k in ("l", "c", "r")], [F.col(f"{k}_") for k in ("l", "c", "r")]
    w = [F.when(turned, y).otherwise(x).alias(n) for x, y, n in zip(own + other, other + own, ("l", "c", "r", "l2", "c2", "r2"))]
    pairs = met.groupBy(F.least("uid", "other").alias("uid"), F.greatest("uid", "other").alias("lead")).agg(F.collect_list(F.struct("fn", *w)).alias("windows"), F.bit_or(F.expr("shiftleft(1, fn)")).alias("fns"))
    pairs = pairs.where(F.bit_count("fns") >= agree).select("uid", "lead", "windows")
    return _verified(picked, pairs.mapInArrow(_join_intervals(agree), _REGIONS), least_words, similarity)


def _verified(picked: DataFrame, pairs: DataFrame, least_words: int, similarity: float, texts: DataFrame | None = None) -> DataFrame:
    """Verified passages of pairs(uid, lead, regions)."""
    pairs = materialize(pairs, "passage-pairs")
    if texts is None:
        texts = _texts_of(picked, pairs.select("uid").unionByName(pairs.select(F.col("lead").alias("uid"))))
    sides = pairs.join(texts, "uid").join(texts.select(F.col("uid").alias("lead"), F.col("packed").alias("lead_packed")), "lead")
    sides = sides.select("uid", "packed", "lead", "lead_packed", "regions").sortWithinPartitions("lead")
    return materialize(sides.mapInArrow(_verify(least_words, similarity), _FOUND), "passages")


def _texts_of(picked: DataFrame, uids: DataFrame) -> DataFrame:
    """(uid, packed) of those texts, each once."""
    needed = materialize(uids.distinct(), "passage-uids")
    texts = picked.select("uid", "text").mapInArrow(_pack, "uid long, packed binary")
    return materialize(texts.join(needed.hint("shuffle_hash"), "uid", "left_semi").dropDuplicates(["uid"]), "passage-texts")


def _stretch_shingles(reach: int):
    """(uid, part, shingle, p): the shingles of a text that are within `reach` of one of its places."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, parts, found, where = [], [], [], []
            for uid, part, packed, places, ends in zip(*(c.to_pylist() for c in batch.columns)):
                shingles = _opened(packed)
                mark = np.zeros(len(shingles) + 1, np.int64)
                np.add.at(mark, [max(0, c1 - reach) for c1 in places], 1)
                np.add.at(mark, [min(len(shingles), c2 + reach + 1) for c2 in ends], -1)
                at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                uids.append(np.full(len(at), uid))
                parts.append(np.full(len(at), part))
                found.append(shingles[at].view(np.int64))
                where.append(at.astype(np.int32))
            if uids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (uids, parts, found, where)], names=["uid", "part", "shingle", "p"])

    return emit


def _in_parts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows(part, ...) with the smallest part that links(a, b) between parts reach from theirs."""
    parts = connected_components(links)
    return rows.join(parts.withColumnRenamed("node", "part"), "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component")


def _still_open(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the groups that hold several parts."""
    keys = rows.groupBy(key).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select(key)
    return rows.join(materialize(keys, "open-groups").hint("shuffle_hash"), key, "left_semi")


def _connected(picked: DataFrame, members: DataFrame, led: DataFrame, least_words: int, similarity: float, agree: int) -> DataFrame:
    """led, and the passages that connect members of a group beyond it."""
    least = least_words - SHINGLE + 1
    rows = materialize(_still_open(materialize(_in_parts(members.withColumn("part", F.col("uid")), led.select(F.col("uid").alias("a"), F.col("other_uid").alias("b"))), "group-members"), "key"), "open-members")
    # finer groups: two functions whose windows hold each other's minima and overlap by the least length
    w = ["key", "fn", "l", "c", "c2", "r"]
    twos = rows.join(rows.select("uid", *(F.col(k).alias(f"{k}_") for k in w)), "uid").where(f"fn < fn_ and c <= r_ and c2 >= l_ and c_ <= r and c2_ >= l and least(r, r_) - greatest(l, l_) >= {least - 1}")
    if agree < 2:
        twos = rows.select("*", *(F.col(k).alias(f"{k}_") for k in w))
    twos = twos.groupBy(F.xxhash64("key", "key_").alias("two"), "uid").agg(F.first("part").alias("part"), F.max("weight").alias("weight"), *(f(F.least(k, f"{k}_") if f is F.min else F.greatest(k, f"{k}_")).alias(n) for n, k, f in (("c", "c", F.min), ("c2", "c2", F.max))), F.min(F.greatest("l", "l_")).alias("l"), F.max(F.least("r", "r_")).alias("r"))
    twos = materialize(_still_open(materialize(twos, "finer-members"), "two"), "open-members")
    texts = _texts_of(picked, twos.select("uid"))
    twos = materialize(_still_open(_viable(twos, texts, least, similarity), "two"), "viable-members")
    found, leads = led, None
    for _ in range(ROUNDS):
        free = twos
        if leads is not None:  # not of the part that an earlier lead is in
            theirs = leads.join(twos.select("two", F.col("uid").alias("other"), F.col("part").alias("led_part")), ["two", "other"]).select("two", "led_part").distinct()
            free = twos.join(theirs, (twos["two"] == theirs["two"]) & (F.col("part") == F.col("led_part")), "left_anti")
        new = free.groupBy("two").agg(F.max(F.struct("weight", "uid"))["uid"].alias("other"))
        leads = materialize(new if leads is None else new.unionByName(leads), "leads")
        more = _verified(picked, _cross(twos, twos.join(new.withColumnRenamed("other", "uid"), ["two", "uid"], "left_semi"), False), least_words, similarity, texts)
        found = found.unionByName(more)
        if not more.take(1):
            break
        part_of = twos.select("uid", "part").distinct()
        links = more.select("uid", "other_uid").distinct().join(part_of.withColumnRenamed("part", "a"), "uid").join(part_of.select(F.col("uid").alias("other_uid"), F.col("part").alias("b")), "other_uid").select("a", "b")
        twos = materialize(_still_open(materialize(_in_parts(twos, links), "group-members"), "two"), "open-members")
    return found.unionByName(_verified(picked, _cross(twos, twos, True), least_words, similarity, texts))


def _cross(rows: DataFrame, partners: DataFrame, all_pairs: bool) -> DataFrame:
    """(uid, lead, regions): rows and partners of the same finer group in other parts, each pair once, with what their
    windows span in all; nothing is listed for each group that a pair meets in."""
    other = partners.select("two", F.col("uid").alias("other"), F.col("part").alias("other_part"), F.col("l").alias("l_"), F.col("r").alias("r_"))
    met = rows.join(other, "two").where("part <> other_part")
    if all_pairs:
        met = met.where("uid < other")
    turned = F.col("uid") > F.col("other")
    sides = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(n) for x, y, n in (("l", "l_", "la"), ("r", "r_", "ra"), ("l_", "l", "lb"), ("r_", "r", "rb"))]
    met = met.select(F.least("uid", "other").alias("uid"), F.greatest("uid", "other").alias("lead"), *sides)
    pairs = met.groupBy("uid", "lead").agg(*(f(n).alias(n) for n, f in (("la", F.min), ("ra", F.max), ("lb", F.min), ("rb", F.max))))
    return pairs.select("uid", "lead", F.array(F.struct("la", "ra", "lb", "rb")).alias("regions"))


def _viable(rows: DataFrame, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """Rows around whose minima enough shingles also occur in another part."""
    places = rows.groupBy("uid", "part").agg(F.collect_set(F.struct("c", "c2")).alias("p")).select("uid", "part", F.col("p.c").alias("places"), F.col("p.c2").alias("ends"))
    # a link may shift a shingle by what one side has more than the other
    reach = least - 1 + int(least * (1 - similarity) / similarity) + SHINGLE
    shingles = places.join(texts, "uid").select("uid", "part", "packed", "places", "ends").mapInArrow(_stretch_shingles(reach), "uid long, part long, shingle long, p int")
    shingles = materialize(shingles, "open-shingles")
    common = shingles.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("shingle")
    hits = shingles.join(materialize(common, "common-shingles").hint("shuffle_hash"), "shingle", "left_semi").select("uid", "p")
    # stretches of the least length in which enough shingles are common; they are looked up by blocks of that length
    ahead = Window.partitionBy("uid").orderBy("p").rangeBetween(0, least - 1)
    dense = hits.withColumn("n", F.count("*").over(ahead)).where(F.col("n") >= int(similarity * least))
    # the first hit of such a stretch is within the least length of each of its places
    dense = materialize(dense.select("uid", F.expr(f"p div {least}").alias("block")).distinct(), "dense-blocks")
    near = rows.select("uid", "two", F.explode(F.expr(f"sequence((c - {least}) div {least}, (c2 + {least}) div {least})")).alias("block"))
    viable = near.join(dense, ["uid", "block"], "left_semi").select("uid", "two").distinct()
    return rows.join(viable, ["uid", "two"], "left_semi")


def _with_ids(picked: DataFrame, found: DataFrame, least_words: int) -> DataFrame:
    """found with the smallest ids of its texts, and a row for each further id of a text."""
    ids = materialize(picked.select("uid", "doc_id").distinct(), "passage-ids")
    least = materialize(ids.groupBy("uid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "passage-ids")
    # words are counted only in texts that have copies
    several = picked.join(least.where("copies > 1").select("uid").hint("shuffle_hash"), "uid", "left_semi").dropDuplicates(["uid"])
    sizes = several.select("uid", word_count(F.col("text")).alias("n_words")).where(F.col("n_words") >= least_words)
    names = least.select("uid", F.col("least").alias("doc_id"))
    both = found.join(names, "uid").join(names.select(F.col("uid").alias("other_uid"), F.col("doc_id").alias("other_id")), "other_uid")
    columns = ["uid", "doc_id", "other_uid", "other_id", "first_word", "n_words", "other_first", "other_words", "similarity"]
    copies = ids.join(least.where("copies > 1"), "uid").where("not (doc_id <=> least)").join(sizes, "uid")
    zero = F.lit(0)
    copies = copies.select("uid", F.col("least").alias("doc_id"), F.col("uid").alias("other_uid"), F.col("doc_id").alias("other_id"), zero.alias("first_word"), F.col("n_words").cast("int").alias("n_words"), zero.alias("other_first"), F.col("n_words").cast("int").alias("other_words"), F.lit(1.0).alias("similarity"))
    return both.select(*columns).unionByName(copies)


def duplicate_documents(found: DataFrame) -> DataFrame:
    """From repeated_passages: a row for each document that has one, with (doc_id, class_id, n_links, n_words,
    first_word, other_id): its class is named by the smallest doc_id that links of passages reach, n_links are
    the documents it was verified against, the rest is its longest passage. Copies are linked with the copy of the
    smallest id, which alone has the links of their text to others."""
    back = found.select(F.col("other_uid").alias("uid"), F.col("other_id").alias("doc_id"), F.col("uid").alias("other_uid"), F.col("doc_id").alias("other_id"), F.col("other_first").alias("first_word"), F.col("other_words").alias("n_words"))
    sides = found.select("uid", "doc_id", "other_uid", "other_id", "first_word", "n_words").unionByName(back)
    longest = F.max(F.struct("n_words", "first_word", "other_id")).alias("best")
    # a pair may have several passages; links are few a document but for leads, whose links are distinct first
    rows = sides.groupBy("uid", "doc_id", "other_uid", "other_id").agg(longest).groupBy("uid", "doc_id").agg(F.count("*").alias("n_links"), F.max("best").alias("best"))
    parts = connected_components(found.select(F.col("uid").alias("a"), F.col("other_uid").alias("b")))
    rows = rows.join(parts.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    rows = materialize(rows, "passage-classes")
    named = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return rows.join(named, "component").select("doc_id", "class_id", "n_links", "best.n_words", "best.first_word", "best.other_id")
