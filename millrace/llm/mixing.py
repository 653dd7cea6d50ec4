"""Mixing sources to target weights.

Rows get hash-random keys. Within a source they are range-sorted by key: the key's leading bits give a
range, and a source of n rows has about the root of n ranges of as many rows, so one with a third of all rows
is spread as widely as it needs. Rows of one key and size (a null id, or one that many rows repeat) are alike and
count as one. Sums of the ranges are added up, each range adds its running sums, and each source is cut at exactly
its budget; only rows that are like the one at the cut are numbered, by slices. A budget beyond the source's size
repeats whole epochs and cuts the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import carried, materialize, pick

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """sizes(source, source_size) -> with weight and target.

    Sources in order of code points, null last, take the weights in turn. Targets share share x all sizes by
    weight; none is above max_epochs x its source's size, and what is over is shared again among the others
    by weight. Sources are saturated in order of cap / weight, so one sorted pass over the sources (a table
    of one row a source, never of rows) finds the level at which nothing is over.
    """
    turn = F.array(*[F.lit(int(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double") * share)
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("left_weight"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(every)["level"]
    return s.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf")))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, part, taken) for each row of docs.

    size: default, the words of column text (null: 0). taken = epochs x size + part, where epochs are whole
    passes over the source and part is what the row gives in the last one (0, size, or for one row a cut).
    The taken words of a source add up to its target, rounded down. Keys come from the id, so reruns agree;
    rows that repeat an id are ordered by size, and equal rows are alike. A null id is hashed as an empty string,
    null is a source of its own, and a source of empty texts has target 0. An empty table gives an empty result.
    row_col names a column to hand through.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    if size is None:
        docs = pick(docs, **{"text": "text", id_col: id_col, source_col: source_col}, **({row_col: row_col} if row_col else {}))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (word_count(F.col("text")) if size is None else size).alias("size"), key.alias("key"), *([row_col] if row_col else []))
    rows = materialize(rows.withColumn("slice", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "sized")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), "sources")
    targets = source_targets(sizes.select("source", "source_size"), weights, share, max_epochs)
    plan = targets.alias("t").join(sizes.alias("s"), F.expr("t.source <=> s.source")).select("s.source", "t.source_size", "t.target", F.ceil(F.sqrt("source_rows")).alias("ranges"))
    whole = F.expr("cast(floor(target) as bigint)")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = materialize(plan.withColumn("rest", whole - F.col("epochs") * F.col("source_size")), "plan")
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2.0**32))
    alike = ["nameless", "name", "range", "key", "no_id", "size"]
    r = rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source")).select("r.*", *(f"p.{c}" for c in ("source_size", "target", "epochs", "rest")), at.alias("range"), F.coalesce(F.col("r.source"), F.lit("")).alias("name"), F.col("r.source").isNull().alias("nameless"), F.col("r.doc_id").isNull().alias("no_id"))
    groups = r.groupBy(*alike).agg(F.count("*").alias("times"), F.first("rest").alias("group_rest"))
    groups = materialize(groups, "alike")
    sums = groups.groupBy("nameless", "name", "range").agg(F.sum(F.col("size") * F.col("times")).alias("range_size"))
    ahead = Window.partitionBy("nameless", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("nameless", "name", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("nameless", "name", "range").orderBy("key", F.desc("no_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("times")).over(within), F.lit(0))).join(sums, ["nameless", "name", "range"])
    room = (F.col("group_rest") - F.col("offset") - F.col("inside")).alias("room")  # for a group, in the source's last pass
    groups = materialize(groups.select(*alike, "times", room), "alike")
    r = r.join(groups, alike)
    clear = (F.col("room") <= 0) | (F.col("room") >= F.col("size") * F.col("times"))
    every = ["doc_id", "source", "size", "source_size", "target", "epochs", *([row_col] if row_col else [])]
    simple = r.where(clear).select(*every, F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0)).cast("long").alias("part"))
    # a group that the cut goes through: its rows are numbered within their slices, after those of earlier slices
    cut = r.where(~clear)
    counts = cut.groupBy(*alike, "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*alike).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*alike, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy(*alike, "slice").orderBy("place")) - 1
    cut = cut.join(counts, [*alike, "slice"]).select(*every, F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - number * F.col("size"))).cast("long").alias("part"))
    both = simple.unionByName(cut)
    return both.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", *([row_col] if row_col else []), (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, and, for the row at a source's budget, its first
    words up to it. Columns are those of docs, whatever their names; a column n_chars is set to a cut text's length.
    Repeated rows are taken each for itself; texts without a word are never taken. See mix for the rest.
    """
    rows, at, back = carried(docs)
    marked = materialize(rows.withColumn("n", F.monotonically_increasing_id()), "mix-docs")  # read twice, so numbered once
    mixed = mix(marked.select("n", at(id_col).alias("id"), at(source_col).alias("source"), at(text_col).alias("text")), "id", "source", word_count(F.col("text")), row_col="n", **options)
    rows = marked.join(mixed.where("taken > 0").select("n", "size", "epochs", "part").hint("shuffle_hash"), "n")
    none = F.array().cast("array<bigint>")
    passes = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(none))
    rows = rows.withColumn("words", F.explode(passes))
    whole = F.col("words") == F.col("size")
    cut = F.when(whole, at(text_col)).otherwise(first_words(at(text_col), F.col("words")))
    changed = {text_col: cut}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, at("n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    return back(rows, changed)


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    led = text.rlike(r"^[\x20\x09-\x0D]").cast("int")  # white space before the first word is a part of its own
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), (n + led).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         (source_size * 3)::DOUBLE AS cap
  FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
         ((sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
plan AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM chosen)) AS target FROM levels),
ranked AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0
             THEN (floor(target)::BIGINT // source_size) * size
                  + greatest(0, least(size, floor(target)::BIGINT - (floor(target)::BIGINT // source_size) * source_size - before))
             ELSE 0 END)::BIGINT AS taken
FROM ranked
"""
