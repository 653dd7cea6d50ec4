"""Queries of whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import rules, runs
from millrace.plans.registry import query
from millrace.session import shared_base, table

_PROFILE = rules.Profile(roles=[rules.Role("dev", "development", 30, [["developer"]])], skills=[rules.Skill("metal", 10, ["steel", "brass"])], local_places=["fulda"], entry_words=["junior"])


@query(
    "finder_runs",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 <> 0 AS in_a, p_partkey % 2 = 0 AS in_b, p_partkey % 7 = 0 AS gone, regexp_matches(lower(p_name), '(^|[^a-z0-9_])(steel|brass)([^a-z0-9_]|$)') AS metal FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0)
    SELECT CASE WHEN in_a THEN 'a:' ELSE 'b:' END || k AS id,
      CASE WHEN in_a AND NOT gone THEN CASE WHEN in_b THEN 'a b' ELSE 'a' END WHEN in_b THEN 'b' END AS links,
      CASE WHEN (in_a AND NOT gone) OR in_b THEN NOT (in_a AND NOT gone) END AS retained, CASE WHEN (in_a AND NOT gone) OR in_b THEN 60 + CASE WHEN metal THEN 10 ELSE 0 END END::INT AS points,
      CASE WHEN in_a AND NOT gone THEN 'known' WHEN in_b THEN 'kept' ELSE 'missed' END AS transition, CASE WHEN in_a AND NOT gone THEN 'refreshed' ELSE 'kept' END AS queue, 2::BIGINT AS version FROM p""",
)
def finder_runs(spark, d):
    """Two runs over two sources that share listings; in the second one a source fails and the other has lost some."""
    path = f"{shared_base(spark)}/runs-{uuid.uuid4().hex}"
    p, k = table(spark, d, "part"), F.col("p_partkey")
    n = k.cast("string")

    def source(name: str, rows):
        link = F.struct(F.lit(name).alias("source"), F.concat(F.lit(f"{name}/"), n).alias("url"))
        filler = F.lit(f"Wir bauen Software, Quelle {name}.")
        return lambda _: rows.select(F.concat(F.lit(f"{name}:"), n).alias("id"), k.alias("ord"), F.concat(F.lit("Developer "), n, F.lit(" "), F.col("p_name")).alias("title"), F.lit("Acme").alias("company"), F.array(F.lit("Fulda")).alias("locations"), F.array(link).alias("sources"), filler.alias("description"), F.lit("").alias("remote"), F.lit(False).alias("fully_remote"), F.lit(True).alias("is_new"))

    def broken(_):
        raise OSError("no route")

    a, b = p.where(k % 3 != 0), p.where(k % 2 == 0)
    day = lambda t: F.lit(t).cast("timestamp")
    runs.run(spark, path, {"a": source("a", a), "b": source("b", b)}, _PROFILE, day("2024-01-01 06:00:00"))
    last, _ = runs.run(spark, path, {"a": source("a", a.where(k % 7 != 0)), "b": broken}, _PROFILE, day("2024-01-02 06:00:00"))
    parts = {name: runs.published(spark, path, name, last) for name in ("cards", "state", "pending")}
    cards = parts["cards"].select("id", F.array_join("links.source", " ").alias("links"), "retained", F.col("match_percent").alias("points"))
    out = parts["state"].select("id", "transition").join(cards, "id", "full_outer").join(parts["pending"].select("id", F.col("action").alias("queue")), "id", "full_outer")
    return out.select("id", "links", "retained", "points", "transition", "queue", F.lit(last["version"]).cast("long").alias("version"))
