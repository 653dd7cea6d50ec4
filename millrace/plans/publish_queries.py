"""Queries of identity resolution, visibility, notifications and past decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.operators import backup, history, identity, publish, ranks, review
from millrace.plans.registry import query
from millrace.session import table


@query(
    "region_allowed",
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'France; Germany' WHEN 2 THEN 'USA/Canada' WHEN 3 THEN 'EU | UK' ELSE '' END AS labels, CASE WHEN c_custkey % 7 = 0 THEN 'DE' WHEN c_custkey % 11 = 0 THEN 'fr' END AS code FROM customer)
    SELECT c_custkey, CASE WHEN code IS NOT NULL THEN lower(code) IN ('de', 'germany') WHEN coalesce(labels, '') = '' THEN true
      ELSE list_has_any(list_transform(regexp_split_to_array(lower(labels), '[,;/|]+'), lambda x: trim(x)), ['de', 'germany', 'eu', 'europe']) END AS allowed FROM t""",
)
def region_allowed(spark, d):
    k = F.col("c_custkey")
    labels = F.when(k % 5 == 1, "France; Germany").when(k % 5 == 2, "USA/Canada").when(k % 5 == 3, "EU | UK").when(k % 5 == 4, "")
    code = F.when(k % 7 == 0, "DE").when(k % 11 == 0, "fr")
    return table(spark, d, "customer").select("c_custkey", publish.region_allows(labels, code, ("de", "germany"), ("eu", "europe")).alias("allowed"))


@query(
    "visible_cards",
    """WITH t AS (SELECT s_suppkey, list_contains(regexp_split_to_array(lower(n_name), '[^a-zäöüß]+'), 'united') OR contains(lower(n_name), 'china') AS abroad, s_suppkey % 6 = 0 AS by_hand, s_suppkey % 4 = 0 AS elsewhere FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey, abroad, by_hand OR (NOT abroad AND NOT elsewhere) AS shown, NOT abroad AND (by_hand OR (NOT abroad AND NOT elsewhere)) AND s_suppkey % 3 <> 0 AS told FROM t""",
)
def visible_cards(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    abroad = publish.international(F.array("n_name"), F.array(F.lit("board")), F.lit(""), ("united",), ("china",), ("feed",), ("and",), ("und",))
    shown = publish.visible(F.lit("new"), F.when(k % 4 == 0, "entry level, hybrid elsewhere"), abroad, k % 6 == 0)
    return j.select("s_suppkey", abroad.alias("abroad"), shown.alias("shown"), publish.notifiable(F.when(k % 3 == 0, "ignored"), abroad, shown).alias("told"))


@query("new_by_source", "SELECT source, count(*)::BIGINT AS n FROM (SELECT 's' || (o_orderkey % 3) AS source FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 's5' FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) GROUP BY 1")
def new_by_source(spark, d):
    link = lambda s: F.struct(s.alias("source"))
    one = link(F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")))
    rows = table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.array(one, link(F.lit("s5")))).otherwise(F.array(one, one)).alias("sources"))
    return publish.new_by_source(rows, F.col("o_orderstatus") == "O")


@query(
    "past_decisions",
    """WITH t AS (SELECT o_orderkey AS id, o_orderpriority AS title, 'acme ' || (o_custkey % 20) AS company, o_orderdate::DATE AS decided_on FROM orders),
    m AS (SELECT *, CASE WHEN company = 'acme 7' THEN 'company' WHEN regexp_matches(lower(title), '(^|[^a-z])urgent([^a-z]|$)') THEN 'title' END AS match FROM t WHERE id <> 7)
    SELECT id, match FROM m WHERE match IS NOT NULL ORDER BY match <> 'company', decided_on DESC, id LIMIT 10""",
)
def past_decisions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("ACME "), (F.col("o_custkey") % 20).cast("string"), F.lit(" GmbH")).alias("company"), F.to_date("o_orderdate").alias("decided_on"))
    return publish.past_decisions(rows, 7, "Acme 7", ["urgent", "no"]).select("id", "match")


@query(
    "review_filter",
    """SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND contains(lower(p_name || ' ' || p_brand), 'ring') AND (p_partkey % 9 = 0 OR p_type <> 'PROMO')""",
)
def review_filter(spark, d):
    p = table(spark, d, "part")
    cards = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "new").otherwise("ignored").alias("status"), F.lit(None).cast("string").alias("role_group"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), (F.col("p_partkey") % 9 == 0).alias("by_hand"), (F.col("p_type") == "PROMO").alias("international"), F.lit("x").alias("location_precheck"))
    return publish.review_filter(cards, status="new", query=" RING ").select("p_partkey")


@query(
    "identity_by_url",
    """SELECT 'l' || page_id AS listing_id, CASE WHEN page_id % 2 = 0 THEN 'e' || page_id ELSE 'l' || page_id END AS canonical_id FROM pages""",
)
def identity_by_url(spark, d):
    p = table(spark, d, "pages")
    n = F.col("page_id").cast("string")
    listings = p.select(F.concat(F.lit("l"), n).alias("id"), F.lit("").alias("title"), F.lit("").alias("company"), F.array(F.concat(F.lit("u"), n)).alias("urls"), F.array(F.lit("x")).alias("locations"), F.lit(False).alias("fully_remote"), F.lit(None).cast("date").alias("published_on"))
    entries = p.where("page_id % 2 = 0").select(F.concat(F.lit("e"), n).alias("id"), F.lit("").alias("title"), F.lit("").alias("company"), F.array(F.concat(F.lit("u"), n)).alias("urls"), F.array(F.lit("x")).alias("locations"), F.lit(False).alias("fully_remote"), F.lit("new").alias("status"), F.lit(False).alias("decided"), F.lit(False).alias("applied"), F.lit(False).alias("completed"), F.lit(True).alias("active"), F.lit("2024-01-01").alias("first_seen"), F.lit(None).cast("date").alias("dated_on"))
    aliases = spark.createDataFrame([], "alias string, id string")
    return identity.resolve(listings, entries, aliases, F.lit("2024-01-02").cast("date")).select("listing_id", "canonical_id")


@query("history_fold")
def history_fold(spark, d):
    """Orders as commands on their customers' histories."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 10 == 0, "undo").otherwise("set").alias("kind"), F.when(F.col("o_orderstatus") == "F", "ignored").otherwise("interesting").alias("status"), day.alias("day"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("seen_status"), F.lit(None).cast("string").alias("seen_day"))
    state = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("new").alias("status"), F.lit("1992-01-01").alias("first_seen"), F.array().cast("array<struct<status:string,day:string>>").alias("history"))
    out = history.fold(state, o)
    return out.select("id", "status", F.size("history").alias("events"), F.size("refused").alias("refused"))


_DIGEST = """SELECT '{t}' AS name, count(*)::BIGINT AS rows, sha256(concat_ws(',', sum(p[1])::VARCHAR, sum(p[2])::VARCHAR, sum(p[3])::VARCHAR, sum(p[4])::VARCHAR)) AS digest
    FROM (SELECT [('0x' || substr(h, 1, 15))::HUGEINT, ('0x' || substr(h, 16, 15))::HUGEINT, ('0x' || substr(h, 31, 15))::HUGEINT, ('0x' || substr(h, 46, 15))::HUGEINT] AS p FROM (SELECT sha256(to_json({row})::VARCHAR) AS h FROM {t}))"""


@query("table_digests", " UNION ALL ".join(_DIGEST.format(t=t, row=row) for t, row in (("nation", "{'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey}"), ("region", "{'r_name': r_name, 'r_regionkey': r_regionkey}"), ("supplier", "{'s_name': s_name, 's_nationkey': s_nationkey, 's_suppkey': s_suppkey}"))))
def table_digests(spark, d):
    """Counts and digests of all rows, as a snapshot's manifest has them."""
    columns = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "supplier": ["s_suppkey", "s_name", "s_nationkey"]}
    parts = [backup.digest_of(table(spark, d, t).select(*c).repartition(3)).select(F.lit(t).alias("name"), "rows", "digest") for t, c in columns.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "identity_routes",
    """SELECT 'l' || page_id AS listing_id, CASE WHEN page_id % 8 IN (0, 1, 3, 4) OR page_id % 8 = 6 AND page_id % 60 <= 30 THEN 'e' ELSE 'l' END || page_id AS canonical_id FROM pages""",
)
def identity_routes(spark, d):
    """By alias; by title and company, free or decided here or elsewhere; without a company, applied for or not; a completed
    application of up to 59 days ago; and nobody."""
    p = table(spark, d, "pages").select("page_id")
    n, route = F.col("page_id").cast("string"), F.col("page_id") % 8
    now = F.lit("2024-03-01").cast("date")
    of = lambda *routes: route.isin(*routes)
    listings = p.select(F.concat(F.lit("l"), n).alias("id"), F.concat(F.lit("Developer "), n, F.lit(" (m/w/d)")).alias("title"), F.when(of(4, 5), "").otherwise(F.concat(F.lit("Acme "), n, F.lit(" GmbH"))).alias("company"), F.array(F.concat(F.lit("u"), n)).alias("urls"), F.array(F.lit("Fulda")).alias("locations"), F.lit(False).alias("fully_remote"), F.lit(None).cast("date").alias("published_on"))
    applied = of(4, 6)
    entries = p.where(route != 7).select(
        F.concat(F.lit("e"), n).alias("id"), F.when(of(0), "Another title").otherwise(F.concat(F.lit("Developer "), n)).alias("title"), F.concat(F.lit("ACME "), n).alias("company"), F.array().cast("array<string>").alias("urls"),
        F.array(F.when(of(2), "Ulm").otherwise("36037 Fulda")).alias("locations"), F.lit(False).alias("fully_remote"), F.when(of(6), "rejected").when(of(4), "applied").otherwise("new").alias("status"), (applied | of(2, 3)).alias("decided"), applied.alias("applied"), of(6).alias("completed"),
        F.lit(True).alias("active"), F.lit("2024-01-01").alias("first_seen"), F.when(of(6), F.date_sub(now, (F.col("page_id") % 60).cast("int"))).alias("dated_on"),
    )
    aliases = p.where(of(0)).select(F.concat(F.lit("l"), n).alias("alias"), F.concat(F.lit("e"), n).alias("id"))
    return identity.resolve(listings, entries, aliases, now).select("listing_id", "canonical_id")


@query(
    "review_rank",
    """SELECT p_partkey AS id, row_number() OVER (ORDER BY coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 4 END, 2), CASE WHEN p_size % 9 = 0 THEN -1 ELSE p_size END DESC, p_partkey DESC)::BIGINT AS place FROM part""",
)
def review_rank(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int"))
    ordered = review.by_rank(table(spark, d, "part").select(k.alias("id"), "p_partkey", "p_size"), F.when(k % 4 != 0, k % 4), F.when(size % 9 != 0, size), day(F.expr("p_partkey div 3")), day(k))
    return ranks.numbered(ordered.select("id"))
