"""Queries of late details, typed state, cards, rankings and texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import cards, datasets, enrichment, ranks
from millrace.plans.registry import query
from millrace.session import table

_DAY = "1998-08-02 00:00:00"


def _now():
    return F.lit(_DAY).cast("timestamp")


def _pick(k, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


@query(
    "late_details",
    """WITH due AS (SELECT p_partkey FROM part WHERE p_size > 25 AND p_partkey % 3 <> 1 AND NOT (p_partkey % 4 = 0 AND p_partkey % 7 < 3))
    SELECT p.p_partkey AS id, CASE WHEN d.p_partkey IS NULL THEN p_name ELSE 'full ' || p_name END AS title, 'state ' || p_size AS state,
           CASE WHEN p.p_partkey % 3 = 1 THEN 'b|a' WHEN p.p_partkey % 5 = 0 THEN 'a|c' ELSE 'a' END AS links,
           CASE WHEN d.p_partkey IS NULL THEN 'x' WHEN p.p_partkey % 5 = 0 THEN 'y|x' ELSE 'y' END AS places
    FROM part p LEFT JOIN due d USING (p_partkey)""",
)
def late_details(spark, d):
    k = F.col("p_partkey")
    link = lambda s: F.struct(F.lit(s).alias("source"), F.concat(F.lit(f"{s}/"), k.cast("string")).alias("url"))
    sources = F.when(k % 3 == 1, F.array(link("b"), link("a"))).when(k % 5 == 0, F.array(link("a"), link("c"))).otherwise(F.array(link("a")))
    rows = table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("state "), F.col("p_size").cast("string")).alias("state"), F.array(F.lit("x")).alias("locations"), sources.alias("sources"), "p_size")
    cache = rows.where("id % 4 = 0").select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("url"), F.timestamp_seconds(F.unix_timestamp(_now()) - (F.col("id") % 7) * 86400 - 1).alias("fetched_at"))
    due = enrichment.due_for_detail(rows, rows.where("p_size > 25"), cache, "a", _now(), 72)
    details = due.select("id", F.concat(F.lit("full "), "title").alias("title"), F.lit("other").alias("state"), F.array(F.lit("y")).alias("locations"), F.array(F.get("sources", F.lit(0))).alias("sources"))
    out = enrichment.with_details(rows.drop("p_size"), details, "a", ["state"])
    return out.select("id", "title", "state", F.array_join("sources.source", "|").alias("links"), F.array_join("locations", "|").alias("places"))


@query(
    "current_summary",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'new ' || c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN 'old company' ELSE c_mktsegment END AS company,
       CASE WHEN c_custkey % 5 = 0 THEN 'old place' ELSE 'n' || c_nationkey END AS place, c_acctbal AS kept FROM customer WHERE c_custkey % 2 = 0""",
)
def current_summary(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    cached = c.select(k.alias("id"), F.col("c_name").alias("title"), F.lit("old company").alias("company"), F.array(F.lit("old place")).alias("locations"), F.array(F.lit("s")).alias("sources"), F.col("c_acctbal").alias("kept"))
    summary = c.where(k % 2 == 0).select(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("new "), "c_name")).alias("title"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("company"), F.array(F.when(k % 5 == 0, "unknown").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))).alias("locations"), F.array(F.lit("t")).alias("sources"))
    return enrichment.with_current_summary(cached, summary).select("id", "title", "company", F.get("locations", F.lit(0)).alias("place"), "kept")


@query(
    "external_text",
    """SELECT doc_id, CASE WHEN length(text) >= 200 THEN text WHEN length(coalesce(lang, '')) >= length(coalesce(source, '')) THEN coalesce(lang, '') ELSE coalesce(source, '') END AS text
       FROM documents WHERE text IS NOT NULL""",
)
def external_text(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", enrichment.external_text(F.col("text"), F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))).alias("text"))


@query(
    "fallback_paths",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS value, CASE WHEN c_custkey % 6 IN (0) THEN 'full time, trainee' WHEN c_custkey % 2 = 0 THEN 'full time' WHEN c_custkey % 3 = 0 THEN 'trainee' ELSE c_mktsegment END AS kind FROM customer""",
)
def fallback_paths(spark, d):
    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, F.to_json(F.struct(F.struct(F.col("c_name").alias("text")).alias("body")))).when(k % 3 == 1, F.to_json(F.struct(F.struct(F.lit("").alias("text")).alias("body"), F.col("c_mktsegment").alias("summary")))).otherwise(F.lit("{}"))
    kind = enrichment.labelled_flags([(k % 2 == 0, "full time"), (k % 3 == 0, "trainee")], F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", enrichment.first_present(body, "$.body.text", "$.summary").alias("value"), kind.alias("kind"))


@query(
    "drop_closed",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 3 = 0 THEN 1 ELSE 1 + (o_orderkey % 3 = 0)::INT END::INT AS n FROM orders
       WHERE NOT (o_orderkey % 10 = 0 AND o_orderkey % 3 <> 0)""",
)
def drop_closed(spark, d):
    k = F.col("o_orderkey")
    page = F.concat(F.lit("https://x.de/jobs/view/"), k.cast("string"))
    link = lambda s, a: F.struct(F.lit(s).alias("source"), F.lit("u").alias("url"), a.alias("application_url"))
    o = table(spark, d, "orders")
    rows = o.select(k.alias("id"), F.when(k % 3 == 0, F.array(link("r", page), link("s", page))).otherwise(F.array(link("r", F.concat(page, F.lit(" "))))).alias("sources"))
    seconds = lambda n: F.timestamp_seconds(F.unix_timestamp(_now()) - n)
    checks = o.where(k % 10 == 0).select(page.alias("url"), F.lit(True).alias("closed"), seconds(60).alias("checked_at")).unionByName(o.where(k % 10 == 1).select(page.alias("url"), F.lit(True).alias("closed"), seconds(90000).alias("checked_at")))
    checks = checks.unionByName(o.where(k % 10 == 2).select(page.alias("url"), F.lit(True).alias("closed"), seconds(60).alias("checked_at"))).unionByName(o.where(k % 10 == 2).select(page.alias("url"), F.lit(False).alias("closed"), seconds(30).alias("checked_at")))
    checks = checks.unionByName(o.where(k % 10 == 0).select(page.alias("url"), F.lit(None).cast("boolean").alias("closed"), seconds(10).alias("checked_at")))
    return enrichment.drop_closed(rows, checks, "r", _now()).select("id", F.size("sources").alias("n"))


@query(
    "closed_pages",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true END AS closed FROM part""",
)
def closed_pages(spark, d):
    k = F.col("p_partkey")
    final = _pick(k, "https://de.host.com/jobs/view/9", "https://host.com/jobs/search/", "https://www.host.com/jobs/view/7", "https://host.com/jobs/view/7", "https://host.com/login", "https://other.com/jobs/view/9")
    text = F.when(k % 6 == 3, "No longer accepting applications").otherwise("Apply")
    final_id = F.regexp_extract(final, r"view/(\d+)", 1)
    return table(spark, d, "part").select("p_partkey", enrichment.closed_by_page(final, text, F.lit("7"), final_id, "host.com", ["no longer accepting"]).alias("closed"))


@query(
    "typed_state",
    """WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ' ' ORDER BY l_linenumber DESC, l_returnflag) AS lines FROM lineitem WHERE l_orderkey % 4 <> 1 GROUP BY 1),
    e AS (SELECT l_orderkey, count(*)::INT AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
    SELECT o_orderkey, o_orderstatus, coalesce(lines, '') AS lines, coalesce(n, 0)::INT AS n FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN e ON e.l_orderkey = o_orderkey""",
)
def typed_state(spark, d):
    li = table(spark, d, "lineitem").withColumn("o_orderkey", F.col("l_orderkey")).withColumn("position", -F.col("l_linenumber"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    out = datasets.typed_state(rows, "o_orderkey", {"lines": (li.where("l_orderkey % 4 <> 1"), ["l_linenumber", "l_returnflag"]), "many": (li.where("l_quantity > 40"), ["l_quantity"])})
    lines = F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"])), " ")
    return out.select("o_orderkey", "o_orderstatus", lines.alias("lines"), F.size("many").alias("n"))


@query("keyed_reads", "SELECT c_custkey, c_name, 'ids' AS via FROM customer WHERE c_custkey IN (3, 5, 8, 13) UNION ALL SELECT c_custkey, c_name, 'table' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def keyed_reads(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return datasets.lookup(c, "c_custkey", [3, 5, 8, 13]).withColumn("via", F.lit("ids")).unionByName(datasets.lookup(c, "c_custkey", ids).withColumn("via", F.lit("table")))


@query(
    "review_subset",
    """SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'P' OR o_orderkey IN (SELECT c_custkey FROM customer) OR o_custkey IN (SELECT s_suppkey FROM supplier) OR o_orderpriority IN (SELECT '1-URGENT' FROM customer WHERE c_custkey = 1)""",
)
def review_subset(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderpriority")).alias("urls"))
    urls = table(spark, d, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("url")).unionByName(table(spark, d, "customer").where("c_custkey = 1").select(F.lit("1-URGENT").alias("url")))
    return datasets.review_subset(o, table(spark, d, "customer").select(F.col("c_custkey").alias("id")), urls, ["P"]).select("id", "status")


@query("dataset_by_kind", "SELECT p_partkey::INT AS position, p_name AS title, p_size::INT AS points FROM part WHERE p_partkey % 3 = 1")
def dataset_by_kind(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(_pick(k, "cache", "jobs", "sheets").alias("dataset"), k.cast("int").alias("position"), F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_size").cast("int").alias("points"))).alias("payload"))
    return datasets.read_dataset(rows, "jobs", "title string, points int")


@query("versioned_documents", "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 4 = 2 THEN s_name ELSE 'none' END AS name FROM supplier")
def versioned_documents(spark, d):
    k = F.col("s_suppkey")
    payload = F.when(k % 4 == 0, "no json").when(k % 4 == 1, F.to_json(F.struct(F.col("s_name").alias("name")))).otherwise(F.to_json(F.struct((k % 4).alias("version"), F.col("s_name").alias("name"))))
    rows = table(spark, d, "supplier").select(k.alias("key"), payload.alias("payload"))
    return datasets.current_version(rows, 2, F.lit('{"name":"none"}')).select("key", F.get_json_object("payload", "$.name").alias("name"))


@query(
    "event_lines",
    """SELECT '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","run_id":"r' || (user_id % 5) || '","event":"seen","level":"' || CASE WHEN event_type = 'error' THEN 'warning' ELSE 'info' END || '","event_id":' || event_id || ',"kind":"' || event_type || '"}' AS line FROM events""",
)
def event_lines(spark, d):
    rows = table(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "warning").otherwise("info")
    run = F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string"))
    return datasets.event_lines(rows, "seen", run, level, F.col("ts"), {"event_id": F.col("event_id"), "kind": F.col("event_type")})


@query(
    "run_states",
    """WITH one AS (SELECT o_orderkey AS run_id, o_custkey AS runner, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS ended FROM orders),
    n AS (SELECT *, lead(started_at) OVER (PARTITION BY runner ORDER BY started_at, run_id) AS next FROM one)
    SELECT run_id, runner, coalesce(ended, next)::TIMESTAMP AS finished_at, CASE WHEN ended IS NOT NULL THEN 'success' WHEN next IS NOT NULL THEN 'failed' ELSE 'running' END AS outcome FROM n""",
)
def run_states(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("runner"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    starts = o.select("run_id", "runner", "at", F.lit("running").alias("outcome"))
    ends = o.where("o_orderstatus = 'F'").select("run_id", "runner", (F.col("at") + F.expr("interval 1 hour")).alias("at"), F.lit("success").alias("outcome"))
    return datasets.run_states(starts.unionByName(ends)).select("run_id", "runner", "finished_at", "outcome")


@query("latest_upserts", "SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS sheet, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def latest_upserts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("sheet"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return datasets.latest_upserts(rows, ["id"], "o_orderdate", ["sheet"]).drop("o_orderdate")


@query(
    "stored_documents",
    "SELECT s_suppkey AS key, sha256(s_name || CASE WHEN s_suppkey % 3 = 1 THEN '!' ELSE '' END) AS sha256, CASE s_suppkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'conflict' ELSE 'new' END AS action FROM supplier",
)
def stored_documents(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    stored = s.where(k % 3 != 2).select(k.alias("key"), F.sha2(F.col("s_name").cast("binary"), 256).alias("sha256"))
    docs = s.select(k.alias("key"), F.concat("s_name", F.when(k % 3 == 1, "!").otherwise("")).cast("binary").alias("content"))
    return datasets.store_documents(stored, docs).select("key", "sha256", "action")


@query(
    "key_index",
    """SELECT kind, key, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (SELECT 'brand' AS kind, p_brand AS key, p_partkey AS id FROM part
       UNION SELECT 'word', unnest(str_split(p_name, ' ')), p_partkey FROM part) WHERE key <> '' GROUP BY 1, 2""",
)
def key_index(spark, d):
    p = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    rows = datasets.key_rows(p, {"brand": F.array("p_brand"), "word": F.split("p_name", " ")})
    return rows.select("kind", "key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("any_rows", "SELECT true AS found, false AS none")
def any_rows(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    found = datasets.any_rows(o.where("o_orderkey < 0"), c)
    none = datasets.any_rows(o.where("o_orderkey < 0"), c.where("c_custkey < 0")).withColumnRenamed("found", "none")
    return found.crossJoin(F.broadcast(none))  # one row each


@query(
    "entry_predicates",
    """SELECT o_orderkey, o_orderkey % 4 = 0 AND o_orderstatus = 'F' AS archived, o_orderstatus = 'P' OR o_orderkey % 3 = 0 AS applied, o_orderstatus <> 'O' OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS manual FROM orders""",
)
def entry_predicates(spark, d):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "ignored").when(F.col("o_orderstatus") == "P", "applied").otherwise("new")
    record = F.when(k % 4 == 0, F.create_map(F.lit("archived_on"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    event = F.struct(F.lit("interview").alias("status"))
    history = F.when(k % 3 == 0, F.array(event)).when(k % 3 == 1, F.array().cast("array<struct<status:string>>"))
    return table(spark, d, "orders").select("o_orderkey", cards.archived(status, record).alias("archived"), cards.has_application(status, history, ["applied", "interview"]).alias("applied"), cards.has_manual_state(status, history, F.lit(None).cast("string"), F.when(k % 5 == 0, "good").otherwise("")).alias("manual"))


@query("public_documents", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a' || p_partkey || ':cv:' || p_brand ELSE '' END AS documents FROM part")
def public_documents(spark, d):
    doc = lambda i, kind, name: F.struct(i.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.lit("/secret").alias("path"))
    own = F.concat(F.lit("a"), F.col("p_partkey").cast("string"))
    docs = F.array(doc(own, "other", F.col("p_brand")), doc(own, "cv", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")), doc(F.lit(None).cast("string"), "cv", F.col("p_brand")))
    public = cards.public_documents(docs, ["cv", "letter"])
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(public, lambda x: F.concat_ws(":", x["id"], x["kind"], x["name"])), " ").alias("documents"))


@query(
    "recommendation",
    """SELECT p_partkey AS id, p_name AS title, p_size > 40 AS is_new, CASE WHEN p_partkey % 2 = 0 THEN 'b' || p_partkey ELSE 'c' END AS url, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END::INT AS links,
       CASE WHEN p_size % 5 = 0 THEN 'warning=' || p_brand ELSE '' END AS extra FROM part""",
)
def recommendation(spark, d):
    k = F.col("p_partkey")
    link = lambda u: F.struct(F.lit("s").alias("source"), u.alias("url"))
    sources = F.array(link(F.lit("")), link(F.when(k % 2 == 0, F.concat(F.lit("b"), k.cast("string"))).otherwise("c")), link(F.lit("c")))
    rows = table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 40, True).alias("is_new"), sources.alias("sources"), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).alias("warning"), F.lit("").alias("precheck"))
    out = cards.recommendation(rows, ["title"], ["warning", "precheck"])
    return out.select("id", "title", "is_new", "url", F.size("links").alias("links"), F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("extra"))


@query("chosen_sources", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def chosen_sources(spark, d):
    chosen = cards.chosen_sources(["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE"], exclude=["HOUSEHOLD", "AUTOMOBILE"], groups={"FURNITURE BUILDING": ["BUILDING"]})
    return cards.of_sources(table(spark, d, "customer"), chosen, "c_mktsegment").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def _order(rows, *columns):
    """Rows with their place in the order that an operator gave them."""
    return ranks.numbered(rows.select(*columns)).withColumn("place", F.col("place").cast("int"))


_RESULTS = "SELECT p_partkey AS id, p_size AS points, p_partkey % 4 AS rank, p_name AS title FROM part WHERE p_partkey % 5 <> 0"


@query("result_ranking", f"SELECT id, row_number() OVER (ORDER BY points DESC, rank, lower(title), id)::INT AS place FROM ({_RESULTS})")
def result_ranking(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("id"), F.col("p_size").alias("match_percent"), (k % 4).alias("experience_rank"), F.col("p_name").alias("title"), F.when(k % 5 == 0, "excluded").otherwise("included").alias("filter_status"))
    return _order(cards.ranked(rows), "id")


@query("retained_order", "SELECT p_partkey AS id, row_number() OVER (ORDER BY CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size END DESC, lower(p_name), p_partkey)::INT AS place FROM part")
def retained_order(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("match_percent"), F.col("p_name").alias("title"))
    return _order(cards.retained_order(rows), "id")


@query(
    "replace_card",
    """WITH c AS (SELECT min(p_partkey) AS id, min(p_brand) AS brand FROM part), k AS (SELECT p_partkey AS id, p_size AS points, p_name AS title FROM part, c WHERE p_partkey <> c.id AND p_brand <> c.brand UNION ALL SELECT id, 33, 'New card' FROM c)
    SELECT id, points, row_number() OVER (ORDER BY points DESC, lower(title), id)::INT AS place FROM k""",
)
def replace_card(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("match_percent"), F.col("p_name").alias("title"), F.array("p_brand").alias("urls"))
    card = p.agg(F.min("id").alias("id"), F.min(F.get("urls", F.lit(0))).alias("b")).select("id", F.lit(33).cast(p.schema["match_percent"].dataType).alias("match_percent"), F.lit("New card").alias("title"), F.array("b").alias("urls"))
    return _order(cards.replace_card(p, card).withColumnRenamed("match_percent", "points"), "id", "points")


@query(
    "overview_order",
    """SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey % 3 <> 0, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END DESC,
       CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '1990-01-01' END DESC, o_orderkey)::INT AS place FROM orders WHERE o_orderstatus IN ('O', 'P')""",
)
def overview_order(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, d, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("workflow_status"), F.when(k % 3 == 0, day).alias("next_appointment_at"), F.when(k % 5 == 0, day).alias("last_appointment_at"), F.when(k % 2 == 0, day).otherwise("").alias("applied_on"), F.lit("1990-01-01").alias("last_event_on"))
    return _order(cards.overview(rows, ["O", "P"]), "id")


@query(
    "open_first",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'O', o_orderkey) AS rn FROM orders)
    SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY rn) AS keys FROM o WHERE rn <= 2 GROUP BY 1""",
)
def open_first(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("position"), (F.col("o_orderstatus") == "O").alias("open")).alias("a"))
    listed = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("a")).alias("a"))
    return listed.select("o_custkey", F.array_join(F.transform(cards.at_most(cards.open_first(F.col("a"))), lambda x: x["position"].cast("string")), " ").alias("keys"))


@query("with_archived", "SELECT id, v, row_number() OVER (ORDER BY v DESC, id)::INT AS place FROM (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, -1.0 FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0)")
def with_archived(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("v"))
    out = cards.with_archived(c.where("id % 2 = 0"), c.where("id % 3 = 0").withColumn("v", F.lit(-1.0)), [F.desc("v"), "id"])
    return _order(out, "id", "v")


@query(
    "review_diagnostics",
    """SELECT count_if(p_size > 10 AND p_partkey % 3 = 0)::BIGINT AS new_included, count_if(p_size <= 10 AND p_partkey % 3 = 0)::BIGINT AS new_excluded, count_if(p_size > 10 AND p_partkey % 2 = 0)::BIGINT AS pending,
       count_if(p_size > 10 AND p_partkey % 2 = 0 AND p_size < 40)::BIGINT AS pending_shown FROM part""",
)
def review_diagnostics(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.when(F.col("p_size") > 10, "included").otherwise("excluded").alias("filter_status"), (k % 3 == 0).alias("is_new"), F.when(k % 2 == 0, "new").when(k % 5 != 0, "seen").alias("workflow_status"), "p_size")
    return cards.diagnostics(rows, F.col("p_size") < 40)


@query(
    "clean_names",
    """SELECT s_suppkey, 'Dev ' || s_suppkey || ' (m/w/d)' AS title, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Acme ' || s_suppkey END AS company, CASE WHEN s_suppkey % 2 = 0 THEN 'src' END AS source FROM supplier""",
)
def clean_names(spark, d):
    k = F.col("s_suppkey")
    n = k.cast("string")
    title = F.concat(F.lit(" Dev "), n, F.lit(" (m/w/d)"), F.when(k % 2 == 0, " Vollzeit Fulda").otherwise(""))
    company = F.when(k % 3 == 0, " The Board ").otherwise(F.concat(F.lit(" Acme\n "), n, F.when(k % 2 == 0, "_2024-spring").otherwise("")))
    return table(spark, d, "supplier").select("s_suppkey", cards.clean_title(title, ["m/w/d", "w/m/d"]).alias("title"), cards.blank_placeholder(cards.clean_company(company), ["the board"]).alias("company"), cards.inferred_source(F.when(k % 2 == 0, F.concat(F.lit("src:"), n)).otherwise(n)).alias("source"))


@query("clear_placeholders", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 2 THEN '' ELSE 'Board' END AS company FROM customer")
def clear_placeholders(spark, d):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    names = F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("board"))).when(k % 3 == 2, F.array(F.lit("x"))).otherwise(none)
    rows = table(spark, d, "customer").select(F.concat(F.lit("board:"), k.cast("string")).alias("id"), F.lit("Board").alias("company"), F.when(k % 2 == 0, names).otherwise(F.array(F.lit("y"))).alias("source_names"), (k % 5 == 0).alias("edited"))
    out = cards.clear_placeholders(rows, "board", ["board"])
    return out.select(F.split("id", ":")[1].alias("id"), "company")


@query(
    "progress",
    """SELECT p_partkey, round_even(p_size / 50.0 * 100, 0)::INT AS percent, (p_size / (p_partkey % 10 + 1))::DOUBLE AS rate, CASE WHEN p_partkey % 10 + 1 >= 5 AND p_size < 50 THEN (50 - p_size) / (p_size / (p_partkey % 10 + 1)) END::DOUBLE AS eta FROM part""",
)
def progress(spark, d):
    return table(spark, d, "part").select("p_partkey", cards.progress(F.col("p_size"), F.lit(50), (F.col("p_partkey") % 10 + 1).cast("double")).alias("p")).select("p_partkey", "p.*")


@query("agent_links", "SELECT p_partkey, 'u' || p_size || ' ' || p_brand AS links, p_name AS next_appointment_at, p_brand AS next_appointment_status FROM part")
def agent_links(spark, d):
    u = F.concat(F.lit("u"), F.col("p_size").cast("string"))
    links = cards.agent_links(F.array(u, F.lit(""), F.lit(None).cast("string"), F.lit("known"), F.col("p_brand"), u), F.array(F.lit("known")))
    event = F.struct(F.col("p_name").alias("scheduled_for"), F.col("p_brand").alias("status"))
    return table(spark, d, "part").select("p_partkey", F.array_join(links, " ").alias("links"), *cards.appointment_columns("next", event))


@query(
    "remembered_cards",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'unknown post' ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'u' || c_custkey END AS url,
       CASE WHEN c_custkey % 7 = 0 THEN 'gone' WHEN c_custkey % 3 <> 0 THEN 'not seen in this run' ELSE 'not seen in several runs' END AS warning FROM customer""",
)
def remembered_cards(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 5 != 0, F.col("c_name")).alias("title"), F.lit("c").alias("company"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("u"), k.cast("string")))).alias("urls"), F.lit("interesting").alias("status"), F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("active"), (k % 7 == 0).alias("archived"))
    return cards.remembered(rows).select("id", "title", "url", "warning")


@query(
    "messages",
    """SELECT p_partkey AS id, p_name AS title, '**' || CASE WHEN p_size % 4 = 0 THEN 'unknown company' ELSE p_brand END || '** ' || CASE WHEN p_partkey % 2 = 0 THEN 'Fulda, Bonn' ELSE 'unknown' END || ' · ' || p_size || '%' AS description,
       'new · dev · ' || p_size || '/100' AS first, 'https://h/review?job=' || p_partkey AS review FROM part""",
)
def messages(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("title"), F.lit("u").alias("url"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("company"), F.when(k % 2 == 0, F.array(F.lit("Fulda"), F.lit("Bonn"))).otherwise(F.array().cast("array<string>")).alias("locations"), F.col("p_size").alias("remote_percentage"), F.lit("hybrid").alias("work_mode"), F.lit("dev").alias("role_label"), F.col("p_size").alias("match_percent"), F.lit("").alias("experience_level"), F.lit(None).cast("string").alias("location_precheck"))
    out = cards.message(rows, "h")
    at = lambda path: F.get_json_object("payload", path)
    return out.select("id", at("$.title").alias("title"), at("$.description").alias("description"), at("$.fields[0].value").alias("first"), at("$.fields[3].value").alias("review"))


@query(
    "source_health",
    """WITH r AS (SELECT s_nationkey % 5 AS g, 's' || s_suppkey AS name, CASE s_suppkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'success' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE 0 END AS new FROM supplier)
    SELECT count(*) || ' checked · ' || count_if(status = 'success') || ' success' || CASE WHEN count_if(status = 'partial') > 0 THEN ' · ' || count_if(status = 'partial') || ' partial' ELSE '' END || CASE WHEN count_if(status = 'failed') > 0 THEN ' · ' || count_if(status = 'failed') || ' failed' ELSE '' END AS health,
           coalesce(string_agg(CASE WHEN new > 0 THEN name || ' ' || new END, ', ' ORDER BY name), 'nothing new') AS new_finds, coalesce(string_agg(CASE WHEN status IN ('partial', 'failed') THEN name || ' ' || status END, ', ' ORDER BY name), '') AS warnings FROM r""",
)
def source_health(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), _pick(k, "success", "partial", "failed", "success").alias("status"), F.when(k % 3 == 0, k).otherwise(0).alias("new"))
    return cards.source_health(rows)


@query(
    "prompts",
    """SELECT doc_id AS id, length(trim(coalesce(text, ''))) > 12000 AS cut, 'Date: 02.08.1998, searches left: 3' || chr(10) || 'Title: t' || doc_id || chr(10) || 'Company: ' || coalesce(source, '') || chr(10) || 'Places: not given' || chr(10)
       || 'Mode: unknown, ' || doc_id % 101 || ' % remote' || chr(10) || 'Pay: ' || CASE WHEN doc_id % 2 = 0 THEN '50.000 EUR to 60.000 EUR' ELSE '60.000 EUR' END || chr(10) || 'Links:' || chr(10) || '- a: u' || chr(10) || 'Text:' || chr(10)
       || CASE WHEN length(trim(coalesce(text, ''))) > 12000 THEN trim(text)[:12000] || chr(10) || '[cut]' WHEN trim(coalesce(text, '')) = '' THEN '(no text)' ELSE trim(text) END AS prompt FROM documents""",
)
def prompts(spark, d):
    k = F.col("doc_id")
    ads = table(spark, d, "documents").select(k.alias("id"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.col("source").alias("company"), F.array().cast("array<string>").alias("locations"), F.lit("").alias("work_mode"), (k % 101).alias("remote_percentage"), F.when(k % 2 == 0, 50000).alias("salary_min"), F.lit(60000).alias("salary_max"), F.array(F.struct(F.lit("a").alias("source"), F.lit("u").alias("url"))).alias("sources"), F.col("text").alias("description"))
    return cards.prompt(ads, F.lit("1998-08-02").cast("date"), 3).select("id", F.endswith("prompt", F.lit("\n[cut]")).alias("cut"), "prompt")


@query(
    "eval_cases",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'for' ELSE 'against' END AS category, 'decision: ' || CASE c_custkey % 3 WHEN 0 THEN 'applied' ELSE 'ignored' END || CASE WHEN c_custkey % 2 = 0 THEN ' – note' ELSE '' END AS why, p_name AS description
       FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 3 <> 2 AND c_custkey % 5 <> 0 AND (c_custkey % 4 = 0 OR p_size > 25) AND c_custkey % 7 <> 0""",
)
def eval_cases(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    decisions = c.select(k.alias("id"), _pick(k, "applied", "ignored", "seen").alias("status"), F.when(k % 2 == 0, "note").otherwise("").alias("note"), F.lit("1998-01-01").cast("date").alias("decided_on"))
    p, n = table(spark, d, "part"), F.col("p_partkey")
    rows = p.select(n.alias("id"), F.when(n % 5 != 0, n).alias("ad_id"), F.when(n % 4 == 0, 0).otherwise(1).alias("experience_rank"), (F.col("p_size") * 2).alias("match_percent"))
    ads = p.select(n.alias("ad_id"), F.when(n % 7 == 0, "").otherwise(F.col("p_name")).alias("description"))
    return cards.eval_cases(decisions, rows, ads, ["applied"], ["ignored"], F.lit(True)).select("id", "category", "why", "description")


@query(
    "link_entries",
    """WITH s AS (SELECT p_partkey AS id, p_partkey % 10 = 0 AS application, p_partkey % 7 = 0 AS documents, p_brand AS url FROM part),
    l AS (SELECT id AS source_id, id - id % 10 AS target_id FROM s WHERE id % 10 BETWEEN 1 AND 3),
    g AS (SELECT l.source_id, l.target_id, s.url FROM l JOIN s ON s.id = l.source_id AND NOT s.documents JOIN s t ON t.id = l.target_id AND t.application),
    m AS (SELECT target_id, string_agg(source_id::VARCHAR, ',' ORDER BY source_id) AS ids FROM g GROUP BY 1), n AS (SELECT target_id, url FROM g UNION SELECT id, url FROM s)
    SELECT s.id, coalesce(m.ids, '') AS linked, CASE WHEN m.ids IS NULL THEN 1 ELSE (SELECT count(*) FROM n WHERE n.target_id = s.id) END::INT AS urls, s.id % 2 = 0 OR m.ids IS NOT NULL AS active
    FROM s LEFT JOIN m ON m.target_id = s.id WHERE s.id NOT IN (SELECT source_id FROM g)""",
)
def link_entries(spark, d):
    k = F.col("p_partkey")
    none = F.array().cast("array<bigint>")
    state = table(spark, d, "part").select(k.alias("id"), (k % 10 == 0).alias("application"), (k % 7 == 0).alias("documents"), none.alias("linked_ids"), F.array("p_brand").alias("urls"), F.array().cast("array<string>").alias("locations"), ((k % 2 == 0) | (k % 10 < 4)).alias("active"))
    state = state.withColumn("active", F.when(F.col("id") % 2 == 0, True).otherwise(F.col("id") % 10 < 4)).withColumn("linked_ids", F.array().cast("array<string>"))
    links = state.where("id % 10 between 1 and 3").select(F.col("id").alias("source_id"), (F.col("id") - F.col("id") % 10).alias("target_id"))
    texts = state.withColumn("id", F.col("id").cast("string"))
    pairs = links.select(F.col("source_id").cast("string"), F.col("target_id").cast("string"))
    out = cards.link_entries(texts, pairs)
    linked = F.array_sort(F.transform("linked_ids", lambda x: x.cast("bigint")))
    kept = out.select(F.col("id").cast("bigint").alias("id"), F.array_join(F.transform(linked, lambda x: x.cast("string")), ",").alias("linked"), F.size("urls").alias("urls"), (F.col("id").cast("bigint") % 2 == 0).alias("even"), "active")
    return kept.select("id", "linked", "urls", (F.col("even") | (F.col("linked") != "")).alias("active"))


@query("metadata_labels", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Entry|Senior' ELSE 'Entry' END AS labels, 's:' || CASE WHEN p_size % 3 = 0 THEN p_partkey::VARCHAR ELSE p_brand END AS id FROM part")
def metadata_labels(spark, d):
    page = F.concat(F.lit('x "contractType" : "Entry, Other'), F.when(F.col("p_size") % 2 == 0, ",Senior").otherwise(""), F.lit('" y "contractType":"Entry"'))
    url = F.concat(F.lit("https://x.de/job-"), F.col("p_partkey").cast("string"), F.lit("?a=b"))
    return table(spark, d, "part").select("p_partkey", F.array_join(cards.allowed_labels(page, "contractType", ["Entry", "Senior"]), "|").alias("labels"), cards.by_url_identity("s", url, F.col("p_size") % 3 == 0, F.col("p_brand")).alias("id"))


@query(
    "load_breakdown",
    """SELECT event_type AS name, user_id % 3 = 0 AS cold, count(*)::BIGINT AS n, quantile_cont(value, 0.5)::DOUBLE AS median, quantile_cont(value, 0.95)::DOUBLE AS p95 FROM events
       WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2""",
)
def load_breakdown(spark, d):
    e = table(spark, d, "events")
    last = e.agg((F.max("ts") - F.expr("interval 7 day")).alias("since"))
    recent = e.where(F.col("event_type").isin("click", "view", "purchase")).join(F.broadcast(last), F.col("ts") > F.col("since"))  # one row
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return recent.groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 3 == 0).alias("cold")).agg(F.count("*").alias("n"), p.alias("p")).select("name", "cold", "n", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"))


@query("typed_rows", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE -1 END::INT AS nation FROM customer WHERE c_custkey % 7 <> 0")
def typed_rows(spark, d):
    k = F.col("c_custkey")
    payload = F.when(k % 7 == 0, "{broken").otherwise(F.to_json(F.struct(F.when(k % 3 != 0, F.col("c_name")).alias("title"), F.when(k % 2 == 0, F.col("c_nationkey")).alias("nation"), F.lit(True).alias("is_new"))))
    rows = table(spark, d, "customer").select("c_custkey", payload.alias("payload"))
    schema = StructType.fromDDL("title string, nation int, is_new boolean")
    return datasets.typed_rows(rows, "payload", schema, {"title": F.lit("unknown"), "nation": F.lit(-1)}, ["is_new"])


@query(
    "attach_listings",
    """WITH s AS (SELECT p_partkey AS id, p_partkey % 10 = 0 AS application, p_partkey % 7 = 0 AS documents, p_brand AS url, p_type AS name, p_size AS rating, p_partkey % 3 <> 0 AS active FROM part),
    r AS (SELECT id AS ord, id AS source_id, id - id % 10 AS target_id FROM s WHERE id % 10 BETWEEN 1 AND 3 UNION ALL SELECT id + 0.5, id, id - id % 10 + 10 FROM s WHERE id % 10 = 2),
    good AS (SELECT r.*, s.url, s.name, s.rating, s.active, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS first FROM r JOIN s t ON t.id = r.target_id AND t.application JOIN s ON s.id = r.source_id AND NOT s.application AND NOT s.documents),
    g AS (SELECT * FROM good WHERE first = 1),
    links AS (SELECT target_id AS id, ord, url, name FROM g UNION ALL SELECT id, -1, url, name FROM s),
    once AS (SELECT id, min(ord) AS ord, url, arg_min(name, ord) AS name FROM links GROUP BY id, url),
    l AS (SELECT id, string_agg(url || '=' || name, '|' ORDER BY ord) AS links FROM once GROUP BY id),
    e AS (SELECT target_id AS id, string_agg(source_id || ':' || rating, ' ' ORDER BY ord) AS kept, bool_or(active) AS active FROM g GROUP BY 1)
    SELECT s.id, l.links, coalesce(e.kept, '') AS kept, s.active OR coalesce(e.active, false) AS active, s.rating FROM s JOIN l USING (id) LEFT JOIN e USING (id) WHERE s.id NOT IN (SELECT source_id FROM g)""",
)
def attach_listings(spark, d):
    """Every tenth part is an application that takes the three after it; one of them is asked for twice."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    state = table(spark, d, "part").select(text(k).alias("id"), (k % 10 == 0).alias("application"), (k % 7 == 0).alias("documents"), none.alias("linked_ids"), F.array("p_brand").alias("urls"), F.array("p_type").alias("names"), none.alias("locations"), (k % 3 != 0).alias("active"), F.col("p_size").alias("rating"))
    n = F.col("id").cast("long")
    asked = state.where(n % 10 > 0).where(n % 10 < 4).select(n.cast("double").alias("ord"), F.col("id").alias("source_id"), text(n - n % 10).alias("target_id"))
    asked = asked.unionByName(state.where(n % 10 == 2).select((n + 0.5).alias("ord"), F.col("id").alias("source_id"), text(n - n % 10 + 10).alias("target_id")))
    out, _ = cards.attach_listings(state, asked)
    links = F.array_join(F.transform(F.arrays_zip("urls", "names"), lambda x: F.concat(x["urls"], F.lit("="), x["names"])), "|")
    kept = F.transform("linked_ids", lambda i: F.concat(i, F.lit(":"), F.get_json_object(F.element_at("linked_entries", i), "$.rating")))
    return out.select(F.col("id").cast("long").alias("id"), links.alias("links"), F.array_join(kept, " ").alias("kept"), "active", "rating")


@query("enrichment_report", "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS name, count_if(o_orderkey % 4 <> 0)::BIGINT AS enriched, count_if(o_orderkey % 4 = 0)::BIGINT AS failed FROM orders WHERE o_orderkey % 3 < 2 OR o_orderkey % 5 = 0 GROUP BY 1 UNION ALL SELECT 'd', 0, 0")
def enrichment_report(spark, d):
    k = F.col("o_orderkey")
    due = table(spark, d, "orders").where((k % 3 < 2) | (k % 5 == 0)).select(F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("c").alias("source"), k.alias("id"))
    found = due.where("id % 4 <> 0")
    return enrichment.enrichment_report(due, found.unionByName(found.where("id % 8 = 1")), ["a", "b", "c", "d"])


@query(
    "message_payload",
    """SELECT p_partkey AS id, '{"id":"' || p_partkey || '","title":"' || p_name || '","match_percent":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE p_size::VARCHAR END || ',"international":' || CASE WHEN p_partkey % 4 = 0 THEN 'true' WHEN p_partkey % 4 = 1 THEN 'false' ELSE (p_size > 25)::VARCHAR END || '}' AS payload FROM part""",
)
def message_payload(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("key"), k.cast("string").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("match_percent"), F.lit("secret").alias("webhook"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("international"), "p_size")
    return rows.select(F.col("key").alias("id"), cards.message_payload(rows, F.col("p_size") > 25).alias("payload"))


@query("archive_records", "SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand AS company, p_size AS salary_min_eur FROM part")
def archive_records(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_size").alias("salary_min_eur"), F.lit("x").alias("note"))
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in cards.ARCHIVED if c not in rows.columns])
    kept = cards.archive_records(rows)
    return kept.select("id", "title", "company", "salary_min_eur") if kept.columns == list(cards.ARCHIVED) else kept
