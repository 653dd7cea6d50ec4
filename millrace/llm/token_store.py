"""Token ids in a content-addressed store.

Format (all tables Parquet under one folder):

    packed/kind=chunks   name (the digest, 16 bytes), n_tokens, payload: each distinct chunk once; little-endian
                         ids of 2 bytes (vocabularies up to 65,536) or 4
    packed/kind=recipes  recipes as they were packed
    recipes/  doc_id, recipe_id, part, run, start, n_tokens, root, digests array<binary>     in ascending doc_id order
    manifest/ level, part, run, recipes, start, stop, n_tokens, root      Merkle roots of runs of recipes, of parts, of all

A rolling hash over the last 8 ids cuts a document's ids into chunks, so that equal passages give equal
chunks wherever they stand. Chunks are named by the digest of their payload. A recipe lists its chunks and
their Merkle root. The manifest carries the tree on: a run of RUN recipes has the Merkle root of theirs, a part
(one range partition) that of its runs, and the store that of its parts.

Documents are encoded once, in one pass. Each task drops chunks that it has met; payloads are dealt by digest
and stored once, recipes (which hold digests only) are dealt by document, so a chunk in a third of all
documents gathers nowhere. Reading back checks the recipes against the manifest, so that a lost, doubled or altered
one is noticed, each chunk against its name and each recipe's chunks against its root;
a document's crc32 is combined from those of its chunks, so payloads are not shuffled again.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._hashing import BASE, mix
from millrace.llm._shared import materialize, pick

MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK, SPAN, RUN = 128, 512, 4096, 8, 4096
_MEMO_ENTRIES, _GROUP_BYTES, _SLOTS = 300_000, 1 << 19, 1 << 17
#: Latin letters, then ASCII marks that begin neither a contraction nor a special token.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)((?:[!-&(-/:;=-@\[-`{-~][!-/:;=-@\[-`{-~]*)?)")
#: The byte-level alphabet for pieces of these: a space is shown as U+0120, a line break as U+010A, and a byte b of a letter beyond ASCII
#: as chr(b) if that is printable there (0xA1-0xAC, 0xAE-0xFF), else as chr(0x100 + its turn among the others).
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_LATIN_BYTES = {10: "\u010a"} | {c: "".join(chr(b if b not in _OTHERS else 256 + _OTHERS.index(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Encoder:
    """Byte-level BPE of the tokenizers library, with the ids of units that have been met before.

    The tokenizer's pattern never joins a non-space with white space after it, gives a space before a non-space to
    the token that starts there, and makes a lone line break between non-spaces a token. So a text may be cut
    before each such space or line break, and the ids of a text are those of its units in turn. Units are found
    and looked up for many texts at once, by their very bytes; only new ones are encoded. A new unit of Latin letters, or of
    these and marks after them, is what the pattern would hand to the model in one or two pieces, and goes to the
    library's model directly; any other goes through the whole tokenizer. The memo is emptied when it is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memo: dict[bytes, bytes] = {}
        # in front of it, looked up in numpy: a unit of at most 16 bytes for each slot, its bytes as two numbers, its length
        self.slot_low, self.slot_high = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)
        self.slot_sizes = np.zeros(_SLOTS, np.int64)
        self.slot_ids = np.empty(_SLOTS, object)
        self.marks: dict[str, bytes] = {"": b""}

    def direct(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, text: str, space: str = "") -> bytes:
        """Ids of one piece of the pattern; space: as the byte-level alphabet shows it."""
        if not text.isascii() or text == "\n":
            text = text.translate(_LATIN_BYTES)
        return array(self.code, [t.id for t in self.model.tokenize(space + text)]).tobytes()

    def _piece_of_marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[marks] = self.piece(marks)
        return self.marks[marks]

    def unit(self, text: str) -> bytes:
        """Ids of a unit with the space or line break that leads it."""
        if text[0] == " " and text.isascii() and text[1:].isalpha():
            return self.piece(text[1:], "\u0120")
        lead = text[0] if text[0] in " \n" else ""
        found = _PLAIN.fullmatch(text, len(lead))
        if found is None:
            return self.direct(text)
        if lead == " ":
            return self.piece(found[1], "\u0120") + self._piece_of_marks(found[2])
        return self._piece_of_marks(lead) + self.piece(found[1]) + self._piece_of_marks(found[2])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) > _GROUP_BYTES:
                out += self._encode_group(group) + [self._encode_long(text)]
                group, size = [], 0
                continue
            group.append(text)
            size += len(text)
            if size > _GROUP_BYTES:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    def _encode_long(self, text: bytes) -> np.ndarray:
        cuts = np.flatnonzero(_unit_cuts(np.frombuffer(text, np.uint8)))
        parts, a = [], 0
        while a < len(text):
            k = np.searchsorted(cuts, a + _GROUP_BYTES, "right") - 1
            b = int(cuts[k]) if len(text) - a > _GROUP_BYTES and k >= 0 and cuts[k] > a else len(text)
            if b - a > _GROUP_BYTES:  # no place to cut soon enough: up to the next one, or all that is left
                k = np.searchsorted(cuts, a, "right")
                b = int(cuts[k]) if k < len(cuts) else len(text)
                parts.append(np.frombuffer(self.direct(text[a:b].decode("utf-8", "surrogatepass")), self.dtype))
            else:
                parts += self._encode_group([text[a:b]])
            a = b
        return np.concatenate(parts)

    def _encode_group(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"".join(texts)
        if not data:
            return [np.zeros(0, self.dtype) for _ in texts]
        if len(self.memo) > _MEMO_ENTRIES:
            self.memo.clear()
        b = np.frombuffer(data, np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        cut = _unit_cuts(b)
        cut[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(b))
        sizes = ends - starts
        eight = np.ndarray(len(b) + 9, "<u8", data + bytes(16), strides=(1,))  # the 8 bytes from each place on
        low = eight[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]
        high = eight[np.minimum(starts + 8, len(b))] & _FIRST_BYTES[np.clip(sizes - 8, 0, 8)]
        slots = (mix(low * np.uint64(BASE) + high * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(_SLOTS - 1)).astype(np.int64)
        found = self.slot_ids[slots]
        past = np.flatnonzero((self.slot_low[slots] != low) | (self.slot_high[slots] != high) | (self.slot_sizes[slots] != sizes) | (sizes > 16))
        keys = [data[a:z] for a, z in zip(starts[past].tolist(), ends[past].tolist())]
        ids = list(map(self.memo.get, keys))
        for k in [k for k, x in enumerate(ids) if x is None]:
            if (x := self.memo.get(keys[k])) is None:
                x = self.memo[keys[k]] = self.unit(keys[k].decode("utf-8", "surrogatepass"))
            ids[k] = x
        if len(past):
            found[past] = np.fromiter(ids, object, len(ids))
            free = past[(self.slot_sizes[slots[past]] == 0) & (sizes[past] <= 16)]  # frequent units come early and take the slots
            free = free[np.unique(slots[free], return_index=True)[1]]
            self.slot_low[slots[free]], self.slot_high[slots[free]], self.slot_sizes[slots[free]] = low[free], high[free], sizes[free]
            self.slot_ids[slots[free]] = found[free]
        found = found.tolist()
        cuts = np.searchsorted(starts, edges).tolist()
        return [np.frombuffer(b"".join(found[a:z]), self.dtype) for a, z in zip(cuts[:-1], cuts[1:])]


def _unit_cuts(b: np.ndarray) -> np.ndarray:
    """True at spaces before a non-space and at line breaks between non-spaces. Only bytes that can't belong to white
    space count as non-space (ASCII, and letters that UTF-8 writes as 0xC3 and another); leaving out a cut is always
    right."""
    cut = np.zeros(len(b), bool)
    if len(b) > 1:
        solid = (b > 32) & (b < 127)
        latin = b == 0xC3
        before_ok = np.zeros(len(b), bool)
        before_ok[1:] = solid[:-1]
        before_ok[2:] |= latin[:-2]
        cut[:-1] = (solid | latin)[1:] & ((b[:-1] == 32) | (b[:-1] == 10) & before_ok[:-1])
    return cut


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _marks_of(ids: np.ndarray) -> np.ndarray:
    """Ends of the spans of SPAN ids whose hash is a multiple of the mean, in ids of one or many documents."""
    n = len(ids) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    wide = ids.astype(np.uint64) + np.uint64(1)
    h = wide[:n] * np.uint64(BASE)
    for k in range(1, SPAN):
        h += wide[k : n + k]
        h *= np.uint64(BASE)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero(h >> np.uint64(32) & np.uint64(MEAN_CHUNK - 1) == 0) + SPAN


def _cuts(marks: list[int], n: int) -> list[int]:
    out, last = [], 0
    for m in [*marks, n]:
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if m - last >= MIN_CHUNK or m == n and m > last:
            out.append(last := m)
    return out


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    return _cuts(_marks_of(ids).tolist(), len(ids))


def many_cut_points(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Those of documents that follow one another; spans that reach over a document's start do not count."""
    starts = ends - np.diff(ends, prepend=0)
    marks = _marks_of(ids)
    first = np.searchsorted(marks, starts + SPAN).tolist()
    last = np.searchsorted(marks, ends, "right").tolist()
    flat = marks.tolist()
    return [_cuts([m - s for m in flat[i:j]], e - s) for i, j, s, e in zip(first, last, starts.tolist(), ends.tolist())]


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; leaves and nodes are hashed apart, an odd node moves up."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[k] + level[k + 1], digest_size=16).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else hashlib.blake2b(b"", digest_size=16).digest()


_PACKED = pa.schema([("kind", pa.string()), ("name", pa.binary()), ("doc_id", pa.int64()), ("recipe_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary())), ("payload", pa.binary())])
_PACKED_DDL = "kind string, name binary, doc_id long, recipe_id long, n_tokens long, root binary, digests array<binary>, payload binary"


def _pack(path: str, end_id: int):
    """Rows for chunks (name: their digest; n_tokens: their ids) and for recipes (name: 8 bytes of their number)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made, seen = _encoder(path), TaskContext.get().partitionId(), 0, set()
        end = np.array([end_id], encoder.dtype)
        w = encoder.dtype.itemsize
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                own = encoder.encode(batch.column(1)[k : k + 256].to_pylist())
                ids = np.concatenate([x for doc in own for x in (doc, end)])
                ends = np.cumsum([len(x) + 1 for x in own])
                raw, at = ids.tobytes(), 0
                rows: list[tuple] = []
                for doc_id, cuts in zip(batch.column(0)[k : k + 256].to_pylist(), many_cut_points(ids, ends)):
                    a, names = 0, []
                    for b in cuts:
                        payload = raw[(at + a) * w : (at + b) * w]
                        names.append(name := digest(payload))
                        if name not in seen:
                            seen.add(name)
                            rows.append(("chunks", name, None, None, b - a, None, None, payload))
                        a = b
                    recipe = (part << 40) + made
                    made, at = made + 1, at + a
                    rows.append(("recipes", recipe.to_bytes(8, "big"), doc_id, recipe, a, merkle_root(names), names, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED.types)], schema=_PACKED)

    return pack


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row of docs and write chunks, recipes and manifest under path.

    A null text is empty, so its only id is the end id. Repeated rows and rows that share an id each get a
    recipe. A null id comes first. An empty table gives a store without rows.
    """
    spark = docs.sparkSession
    picked = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    packed = picked.mapInArrow(_pack(tokenizer_path, end_id), _PACKED_DDL).repartition("name").dropDuplicates(["name"])
    packed.write.option("compression", "snappy").partitionBy("kind").parquet(f"{path}/packed")
    rows = _packed(spark, path, "recipes").select("doc_id", "recipe_id", "n_tokens", "root", "digests")
    rows = rows.repartitionByRange("doc_id", "recipe_id").sortWithinPartitions("doc_id", "recipe_id").withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "recipes")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("sum"), F.count("*").alias("recipes"), F.min(F.struct("doc_id", "recipe_id")).alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = materialize(parts.withColumn("first_start", F.coalesce(F.sum("sum").over(before), F.lit(0))), "parts")
    inside = Window.partitionBy("part").orderBy("doc_id", "recipe_id")
    summed = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", summed).withColumn("run", F.floor((F.row_number().over(inside) - 1) / RUN).cast("int")).join(parts.select("part", "first_start"), "part")
    placed = placed.select("part", "run", "doc_id", "recipe_id", (F.col("first_start") + F.col("inside")).alias("start"), "n_tokens", "root", "digests")
    placed.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    _manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


_SEAL = "part int, run int, recipes long, start long, stop long, n_tokens long, root binary"


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = pa.array([merkle_root(leaves) for leaves in batch.column(6).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], roots], names=[c.split()[0] for c in _SEAL.split(", ")])


def _sealed(rows: DataFrame) -> DataFrame:
    """rows, as _SEAL names them -> a row for each part and run, its root over theirs in order of start; a recipe has an id
    at least (the end id), so starts differ."""
    leaves = F.transform(F.array_sort(F.collect_list(F.struct("start", "root"))), lambda x: x["root"])
    found = rows.groupBy("part", "run").agg(F.sum("recipes").alias("recipes"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_tokens").alias("n_tokens"), leaves.alias("leaves"))
    return found.mapInArrow(_roots, _SEAL)


def _manifest(recipes: DataFrame) -> DataFrame:
    """Seals of runs (RUN recipes), parts (the runs of a partition) and the store (the parts: as many as there were partitions)."""
    none = F.lit(None).cast("int")
    runs = materialize(_sealed(recipes.select("part", "run", F.lit(1).alias("recipes"), "start", (F.col("start") + F.col("n_tokens")).alias("stop"), "n_tokens", "root")), "runs")
    parts = _sealed(runs.withColumn("run", none))
    store = _sealed(parts.withColumn("part", none))
    level = lambda rows, name: rows.select(F.lit(name).alias("level"), "*")
    return level(runs, "run").unionByName(level(parts, "part")).unionByName(level(store, "store"))


def _check_manifest(spark: SparkSession, path: str) -> None:
    made, kept = _manifest(spark.read.parquet(f"{path}/recipes")), spark.read.parquet(f"{path}/manifest")
    same = F.expr("m.level = k.level and m.part <=> k.part and m.run <=> k.run and m.recipes = k.recipes and m.start = k.start and m.stop = k.stop and m.n_tokens = k.n_tokens and m.n_tokens = m.stop - m.start and m.root = k.root")
    if kept.alias("k").join(made.alias("m"), same, "left_anti").take(1) or made.alias("m").join(kept.alias("k"), F.expr("m.level = k.level and m.part <=> k.part and m.run <=> k.run"), "left_anti").take(1):
        raise ValueError("the recipes are not those that the manifest seals")


def _packed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    ddl = _PACKED_DDL.replace("kind string, ", "")
    rows = spark.read.schema(f"{ddl}, kind string").parquet(f"{path}/packed")
    return rows.where(F.col("kind") == kind)


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of crc32 (reflected: the top bit is x^0)."""
    a, b = np.broadcast_arrays(a.astype(np.uint32), b.astype(np.uint32))
    out, b = np.zeros(a.shape, np.uint32), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out


@cache
def _shifts(most: int = MAX_CHUNK) -> np.ndarray:
    """x^(32 n) for n from 0 to most: what n ids of 4 bytes shift a crc32 by."""
    out, power = np.array([1 << 31], np.uint32), np.array([1 << 31 >> 1], np.uint32)
    for _ in range(5):
        power = _times(power, power)  # x^32
    while len(out) <= most:
        out = np.concatenate([out, _times(out, power)])
        power = _times(power, power)
    return out


def _times_one(a: int, b: int) -> int:
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def combine_crc32(first: np.ndarray, second: np.ndarray, second_ids: np.ndarray) -> np.ndarray:
    """crc32 of ids of 4 bytes from those of two runs of them; the second has at most MAX_CHUNK."""
    shift = _shifts()[second_ids]
    if len(first) < 16:
        product = np.array([_times_one(int(a), int(b)) for a, b in zip(shift, first)], np.uint32)
    else:
        product = _times(shift, first)
    return product ^ second.astype(np.uint32)


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for name, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if digest(payload) != name:
                raise ValueError(f"chunk {name.hex()} does not hold what its name says")
            ids = np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4")
            if len(ids) != n:
                raise ValueError(f"chunk {name.hex()} holds {len(ids)} ids, not {n}")
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["digest", "n_ids", "crc"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = batch.column(4)
        at = chunks.offsets.to_numpy().astype(np.int64)
        flat = chunks.values
        crcs, sizes = flat.field("crc").to_numpy().astype(np.uint32), flat.field("n_ids").to_numpy().astype(np.int64)
        names = flat.field("digest").to_pylist()
        counts = np.diff(at)
        reach = np.concatenate([[0], np.cumsum(sizes)])
        totals, roots = batch.column(2).to_numpy(), batch.column(3).to_pylist()
        for k, root in enumerate(roots):
            if reach[at[k + 1]] - reach[at[k]] != totals[k] or merkle_root(names[at[k] : at[k + 1]]) != root:
                raise ValueError("a recipe does not give the document that its Merkle root names")
        order = np.argsort(-counts, kind="stable")
        crc = np.zeros(len(counts), np.uint32)
        falling = -counts[order]
        for k in range(int(counts.max(initial=0))):
            live = order[: np.searchsorted(falling, -k)]  # recipes with more than k chunks
            here = at[live] + k
            crc[live] = combine_crc32(crc[live], crcs[here], sizes[here]) if k else crcs[here]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each recipe, from the files; recipes that the manifest does not seal, and a
    chunk or recipe that fails its check, raise."""
    _check_manifest(spark, path)
    chunks = _packed(spark, path, "chunks").select(F.col("name").alias("digest"), F.col("n_tokens").cast("int").alias("n_ids"), "payload").mapInArrow(_check_chunks, "digest binary, n_ids int, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    listed = recipes.select("recipe_id", F.posexplode("digests").alias("pos", "digest"))
    found = listed.join(chunks, "digest").groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n_ids", "crc", "digest"))).alias("chunks"))
    whole = recipes.drop("digests").join(found, "recipe_id", "left").select("doc_id", "start", "n_tokens", "root", F.coalesce("chunks", F.array().cast("array<struct<pos:int,n_ids:int,crc:bigint,digest:binary>>")).alias("chunks"))
    return whole.mapInArrow(_rebuild, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>): the documents' ids, rebuilt from their chunks."""
    recipes = spark.read.parquet(f"{path}/recipes").select("recipe_id", "doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    chunks = _packed(spark, path, "chunks").select(F.col("name").alias("digest"), F.col("n_tokens").cast("int").alias("n_ids"), "payload")

    def open_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(p, "<u2" if len(p) == 2 * n else "<u4").astype(np.int32) for n, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["digest", "ids"])

    opened = chunks.mapInArrow(open_chunks, "digest binary, ids array<int>")
    rows = recipes.join(opened, "digest").groupBy("recipe_id", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    return rows.select("doc_id", "start", F.flatten("parts.ids").alias("ids"))
