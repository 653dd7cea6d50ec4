"""Ranked lexical search over postings that are bucketed by term.

build_index writes postings as a table of blocks: a term, the documents of one stretch of the corpus that hold it, how often
each does, and how many terms each has. Blocks are made where the text is read, so a term travels once for each stretch and
not for each document, and a term that a third of all documents hold is many blocks in several slices of its bucket. Rows
without a term list the documents themselves, so one pass over the texts gives all.

search joins the items' terms to the postings of their buckets, scores every match in integers, adds up by item and
document, and numbers the best by a window. A frequent term of many items would give items x documents matches, nearly all
of documents that can't come near the best. These are left out exactly: a term adds at most w times the largest impact
that any of its postings has. The k best documents by rare terms alone, scored in full, give a floor that the k-th best
can't be below; an item's weakest terms whose bounds together stay below half of it need not be matched to find
candidates, as a document with no other term of the item can't reach it. Nor can a candidate whose score by the other
terms and these bounds together stay below it. The best candidates, scored in full, raise the floor; what still reaches
it is scored in full, by all terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import materialize, pick

#: The pattern of terms, as SQL has it; only A-Z are lower-cased.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
_BLOCK_TERMS, _BLOCK_DOCS = 1 << 22, 1 << 15
#: 1,000 and 1,000,000,000 keep three digits of a weight and six of an impact; 8 and 10 to 100 weigh length.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE = 1000, 1_000_000_000, 1000


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: every byte from 0x80 on belongs to a character of a term."""
    return text.translate(_FOLD).split()


class _Ids(dict):
    """A number for each term, in order of first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _block(first: int, doc_ids: list, found: list[np.ndarray], ids: dict[bytes, int], id_type: pa.DataType) -> pa.RecordBatch:
    """A row for each term of a stretch, with its postings (three numbers each: document, occurrences, the document's
    terms), and one with the terms of each document. Documents are numbered from `first` on."""
    docs = len(found)
    sizes = np.array([len(f) for f in found], np.int64)
    keys, tf = np.unique(np.concatenate(found).astype(np.int64) * docs + np.repeat(np.arange(docs), sizes), return_counts=True)
    term, doc = np.divmod(keys, docs)
    ends = 3 * np.append(np.searchsorted(term, np.arange(len(ids))), len(keys))
    flat = np.empty((len(keys), 3), np.int32)
    flat[:, 0], flat[:, 1], flat[:, 2] = doc, tf, sizes[doc]
    postings = pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1] + docs).astype(np.int32)), pa.array(np.concatenate([flat.ravel(), sizes.astype(np.int32)])))
    owners = pa.concat_arrays([pa.nulls(len(ids), pa.list_(id_type)), pa.array([doc_ids], pa.list_(id_type))])
    words = pa.array([*ids, None], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(np.full(len(ids) + 1, first, np.int64)), postings, owners], names=["term", "first", "postings", "doc_ids"])


def _blocks(id_type: pa.DataType, block_terms: int, block_docs: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, doc_ids, found, held, ids = 0, [], [], 0, _Ids()
        for batch in batches:
            for uid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = terms(text.as_py())
                if not own:
                    continue
                first = first if found else uid
                found.append(np.fromiter(map(ids.__getitem__, own), np.int32, len(own)))
                doc_ids.append(doc_id)
                held += len(own)
                if held >= block_terms or len(found) >= block_docs:
                    yield from _sliced(_block(first, doc_ids, found, ids, id_type))
                    doc_ids, found, held, ids = [], [], 0, _Ids()
        if found:
            yield from _sliced(_block(first, doc_ids, found, ids, id_type))

    return make


def _sliced(batch: pa.RecordBatch, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _index_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("term", T.StringType()), T.StructField("first", T.LongType()), T.StructField("postings", T.ArrayType(T.IntegerType())), T.StructField("doc_ids", T.ArrayType(id_type))])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, block_terms: int = _BLOCK_TERMS, block_docs: int = _BLOCK_DOCS) -> None:
    """Write the postings of all documents (whole texts) to path, partitioned by bucket; bucket -1 lists the documents.

    Every row is a document of its own, also one that repeats an id or a text. Null texts and texts without a term are
    in no posting and are not listed. docs should come from a table, as its rows are numbered in the order they are
    read. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    id_type = rows.schema["doc_id"].dataType
    blocks = rows.mapInArrow(_blocks(to_arrow_type(id_type), block_terms, block_docs), _index_schema(id_type))
    slices = -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    blocks = blocks.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int"))
    blocks = blocks.withColumn("slice", F.pmod(F.xxhash64("first"), F.lit(slices)))
    blocks.repartition("bucket", "slice").sortWithinPartitions("bucket", "term", "first").drop("slice").write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_index(spark, path: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """The index at a path; id_type: that of the documents' ids."""
    return spark.read.schema(_index_schema(id_type).add("bucket", T.IntegerType())).parquet(path)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term): the distinct terms of each row of items, which are numbered by item."""
    rows = pick(items, item_id=id_col, text=text_col).withColumn("item", F.monotonically_increasing_id())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.array_distinct(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(TERMS), F.lit(0)))
    return rows.select("item", "item_id", F.explode(found).alias("term"))


def _summed(matches: DataFrame) -> DataFrame:
    """Scores by item and document; matches(item, uid, w, impact)."""
    return matches.groupBy("item", "uid").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def _best(scores: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows of each item, numbered; Spark keeps k of an item in each task before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), *order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", buckets: int = 16, probe: int = 2000, left_out: float = 0.5, most_broadcast: int = 1_000_000, b: int = 90) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (all with a score above 0, if fewer), whole and
    exact. These say how, not what: probe, the matches by rare terms that an item's first bound is sought with; left_out (0 to
    1), the share of that bound that terms may add up to which candidates are found without; most_broadcast, the most rows
    (item, term), of three integers each, that go to all tasks.

    index: what read_index gives, made with as many buckets. Each row of items is an item of its own; a null text
    has no terms. Scores are 64-bit integers; equal ones are ranked by ascending doc_id, null last, and then by
    the documents' order. No items, no documents or no common term: no rows.
    """
    spark = index.sparkSession
    wanted = materialize(item_terms(items, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")), "item-terms")
    listed = index.where("bucket = -1").select("first", F.posexplode(F.arrays_zip(F.col("postings").alias("n"), F.col("doc_ids").alias("doc_id"))))
    listed = materialize(listed.select((F.col("first") + F.col("pos")).alias("uid"), "col.n", "col.doc_id"), "listed-docs")
    totals = listed.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    docs, length = totals["docs"], totals["length"] or 1
    # the postings of the wanted terms, with what a posting counts for: that needs no df
    distinct = materialize(wanted.select("term", "bucket").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    needed = [r["bucket"] for r in distinct.select("bucket").distinct().collect()]
    long = {c: F.col(c).cast("long") for c in ("tf", "n")}
    m = F.expr(f"{100 - b} + ({b} * n * {docs}L) div {length}L")
    impact = F.expr(f"({IMPACT_SCALE}L * tf) div ({TF_SCALE} * tf + 8 * m)").cast("int")
    three = lambda k: F.struct(*(F.get("postings", 3 * k + i).alias(c) for i, c in enumerate(("at", "tf", "n"))))
    postings = index.where(F.col("bucket").isin(needed)).join(distinct, ["bucket", "term"])
    postings = postings.select("tid", "first", F.inline(F.transform(F.sequence(F.lit(0), F.expr("cast(size(postings) div 3 as int) - 1")), three)))
    postings = postings.withColumns(long).withColumn("m", m).select("tid", (F.col("first") + F.col("at")).alias("uid"), impact.alias("impact"))
    postings = materialize(postings, "wanted-postings", compression="zstd")
    weight = F.floor(WEIGHT_SCALE * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1).cast("double")))
    known = postings.groupBy("tid").agg(F.count("*").alias("df"), F.max("impact").alias("most")).withColumn("w", weight).where("w > 0")
    known = wanted.join(distinct, ["bucket", "term"]).join(known, "tid").select("item", "item_id", "tid", "df", "w", (F.col("w") * F.col("most")).alias("bound"))
    known = materialize(known, "weighed-terms")
    # the k best by rare terms, as many as give k documents, and probe matches at least
    rare = Window.partitionBy("item").orderBy("df", "tid").rowsBetween(Window.unboundedPreceding, -1)
    led = known.withColumn("before", F.sum("df").over(rare)).withColumn("largest", F.max("df").over(rare))
    led = led.where(F.col("before").isNull() | (F.col("before") < probe) | (F.col("largest") < k)).select("item", "tid", "w")
    leads = materialize(_best(_summed(postings.join(led, "tid")), k, "uid").select("item", "uid"), "leads")
    floor = _floors(_full_scores(postings, leads, known), k)
    # the weakest terms whose bounds together stay below a share of the floor are not needed to find candidates
    weakest = Window.partitionBy("item").orderBy("bound", "tid").rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("upto") < F.col("floor") * left_out
    bound = known.join(floor, "item").withColumn("upto", F.sum("bound").over(weakest)).withColumn("rest", F.max(F.when(below, F.col("upto"))).over(Window.partitionBy("item")))
    bound = materialize(bound.select("item", "tid", "w", "floor", below.alias("weak"), F.coalesce("rest", F.lit(0)).alias("rest")), "bounds")
    strong = bound.where("not weak").select("item", "tid", "w")
    # with a document's postings in one partition and the terms beside them, matches are added up where they are made
    dealt = postings.repartition("uid")
    found = _summed(dealt.join(F.broadcast(strong) if known.count() <= most_broadcast else strong, "tid"))
    limits = bound.select("item", "floor", "rest").distinct()
    found = materialize(found.join(limits, "item").where(F.col("score") + F.col("rest") >= F.col("floor")).select("item", "uid", "score", "rest"), "candidates", compression="zstd")
    # the best of these, scored in full, raise the floor for the others
    leads = materialize(_best(found, k, "uid").select("item", "uid"), "leads")
    higher = _floors(_full_scores(postings, leads, known), k)
    found = materialize(found.join(higher, "item").where(F.col("score") + F.col("rest") >= F.col("floor")).select("item", "uid"), "candidates")
    scores = _full_scores(postings, found, known).where("score > 0").join(listed.select("uid", "doc_id"), "uid")
    names = wanted.select("item", "item_id").distinct()
    top = _best(scores, k, F.col("doc_id").asc_nulls_last(), "uid")
    return top.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _floors(scores: DataFrame, k: int) -> DataFrame:
    """(item, floor): what the k-th best of an item scores at least; 0 where fewer than k documents are known."""
    return scores.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("floor"))


def _full_scores(postings: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Scores by all terms of the (item, uid) of pairs: postings of their documents alone meet their items' terms."""
    own = postings.join(pairs.select("uid").distinct(), "uid", "left_semi")
    asked = pairs.join(known.select("item", "tid", "w"), "item")
    return _summed(asked.join(own, ["tid", "uid"]))


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}') AS terms FROM documents WHERE text IS NOT NULL),
sized AS MATERIALIZED (SELECT uid, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sized),
p AS MATERIALIZED (SELECT uid, n, term, count(*)::BIGINT AS tf FROM (SELECT uid, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, total GROUP BY term),
items AS (
  SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}'))) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
scores AS (
  SELECT item, item_id, uid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN p USING (term), total GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, uid) AS rank, doc_id, score
  FROM scores JOIN sized USING (uid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
