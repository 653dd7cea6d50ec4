"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a handful of shuffles of (long, long) rows; nothing but a row count and a checksum reaches
the driver. Minima are combined before the shuffle and the joins may be split by AQE, so a node with very
many edges does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, component): component is the smallest node that can be reached.

    Self-loops, repeated edges and both directions of an edge may occur; rows with a null end are left out.
    Nodes without an edge to another node do not appear. An empty table gives an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = written(edges, "components")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "components")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.inline(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        edges = written(small.where("a <> b").distinct(), "components")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
