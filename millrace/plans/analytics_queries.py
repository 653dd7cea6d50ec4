"""Queries of ledgers, operations tables, evaluations, rule scoring and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.operators import evals, ledger, ops, resolve, rules, state
from millrace.plans.registry import query
from millrace.sources import union as sources
from millrace.session import table


@query(
    "ledger_day_month",
    """WITH e AS (SELECT (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS t, value::DECIMAL(18,2) AS v FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-20 22:30:00'),
    m AS (SELECT (TIMESTAMP '2024-01-20 22:30:00' AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS now)
    SELECT coalesce(sum(v) FILTER (t >= date_trunc('day', now)), 0)::DOUBLE AS spent_today, coalesce(sum(v) FILTER (t >= date_trunc('month', now)), 0)::DOUBLE AS spent_month FROM e, m""",
)
def ledger_day_month(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = ledger.spent(e, "ts", "value", F.lit("2024-01-20 22:30:00").cast("timestamp"))
    return out.select(F.col("spent_today").cast("double").alias("spent_today"), F.col("spent_month").cast("double").alias("spent_month"))


@query(
    "call_cost",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (((user_id * 10 - user_id) * 0.25 + user_id * 0.025 + (event_id % 500) * 2.0) / 1000000 + (event_id % 4) * 0.01)::DECIMAL(22,8)::DOUBLE END AS cost FROM events""",
)
def call_cost(spark, d):
    price = F.struct(F.lit("0.25").cast("decimal(10,4)").alias("input"), F.lit("0.025").cast("decimal(10,4)").alias("cached_input"), F.lit("2.0").cast("decimal(10,4)").alias("output"), F.lit("0.01").cast("decimal(10,4)").alias("search"))
    u, e = F.col("user_id"), F.col("event_id")
    cost = N.call_cost(price, u * 10, F.when(e % 11 == 0, u * 10 + 1).otherwise(u), e % 500, e % 4)
    return table(spark, d, "events").select("event_id", cost.cast("decimal(22,8)").cast("double").alias("cost"))


@query(
    "source_status",
    """WITH r AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS rows, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN failed = total AND total > 0 AND rows = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' WHEN rows > 0 THEN 'success' ELSE 'empty' END AS status FROM r""",
)
def source_status(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("rows"), F.count_if(F.col("event_type") == "error").alias("failed_segments"), F.count("*").alias("total_segments"))
    return r.select("user_id", sources.coverage_status().alias("status"))


@query(
    "usable_snapshot",
    """WITH r AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS rows, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY 1),
    s AS (SELECT CASE WHEN failed = total AND rows = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'success' END AS status, rows FROM r),
    n AS (SELECT count(*)::BIGINT AS sources, count_if(status = 'failed' OR (status = 'partial' AND rows = 0))::BIGINT AS unusable FROM s)
    SELECT sources, unusable, sources > 0 AND unusable * 2 <= sources AS usable FROM n""",
)
def usable_snapshot(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("rows"), F.count_if(F.col("event_type") == "error").alias("failed_segments"), F.count("*").alias("total_segments"))
    return sources.usable(r.withColumn("status", sources.coverage_status()))


@query(
    "ops_source_table",
    """SELECT event_type, count(*)::BIGINT AS runs, count_if(value > 50)::BIGINT AS slow, count_if(value < 1)::BIGINT AS quick, round_even(avg(value), 1) AS mean_value, round_even(avg(user_id), 0) AS mean_user FROM events GROUP BY 1""",
)
def ops_source_table(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 50).alias("slow"), F.count_if(F.col("value") < 1).alias("quick"), F.bround(F.avg("value"), 1).alias("mean_value"), F.bround(F.avg("user_id"), 0).alias("mean_user")).orderBy(F.desc("runs"), "event_type")


@query("ops_daily_cost", "SELECT ts::DATE AS day, event_type, sum(value::DECIMAL(18,2))::DOUBLE AS cost, count(*)::BIGINT AS calls FROM events GROUP BY 1, 2")
def ops_daily_cost(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cost"), F.count("*").alias("calls"))


@query("ops_latency", "SELECT event_type, user_id % 2 = 0 AS cold, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def ops_latency(spark, d):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    rows = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2 == 0).alias("cold")).agg(p.alias("p"), F.count("*").alias("n"))
    return rows.select("event_type", "cold", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "n")


@query(
    "token_alerts",
    """WITH w AS (SELECT ts, unnest(range(0, 24)) AS k, value FROM events),
    s AS (SELECT date_trunc('hour', ts) - to_hours(k::INT) AS start, value FROM w)
    SELECT start, round(sum(value), 2) AS total FROM s GROUP BY 1 HAVING sum(value) > 8000""",
)
def token_alerts(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    w = e.groupBy(F.window("ts", "1 day", "1 hour")).agg(F.sum("value").alias("total")).where("total > 8000")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.round("total", 2).alias("total"))


@query(
    "run_durations",
    """SELECT user_id, event_type, round_even(max(value) / 60.0, 1) AS minutes FROM events WHERE starts_with(props, '{"k": 1') GROUP BY 1, 2""",
)
def run_durations(spark, d):
    return table(spark, d, "events").where(F.startswith("props", F.lit('{"k": 1'))).groupBy("user_id", "event_type").agg(F.bround(F.max("value") / 60.0, 1).alias("minutes"))


@query(
    "costs_last_week",
    """SELECT event_type, user_id % 3 AS reason, sum(value::DECIMAL(18,2))::DOUBLE AS cost, count(*)::BIGINT AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2""",
)
def costs_last_week(spark, d):
    e = table(spark, d, "events")
    end = e.agg(F.max("ts").alias("end"))
    recent = e.crossJoin(F.broadcast(end)).where(F.col("ts") > F.col("end") - F.expr("interval 7 days"))  # one row, by its aggregate
    return recent.groupBy("event_type", (F.col("user_id") % 3).alias("reason")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cost"), F.count("*").alias("n"))


@query(
    "backlog",
    """WITH p AS (SELECT user_id, max(ts) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT count(*)::BIGINT AS waiting, min(e.ts) AS oldest, count_if(event_type = 'error')::BIGINT AS failed FROM events e LEFT JOIN p USING (user_id) WHERE event_type <> 'purchase' AND (last_purchase IS NULL OR e.ts > last_purchase)""",
)
def backlog(spark, d):
    e = table(spark, d, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last_purchase"))
    open_ = e.where("event_type <> 'purchase'").join(p, "user_id", "left").where("last_purchase is null or ts > last_purchase")
    return open_.agg(F.count("*").alias("waiting"), F.min("ts").alias("oldest"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query(
    "eval_summary",
    """SELECT lang, source, count(*)::BIGINT AS runs, count_if(quality = 1)::BIGINT AS passed, round_even(100.0 * count_if(quality = 1) / count(*)::DOUBLE, 0)::DOUBLE AS percent,
       sum((n_chars / 1000.0)::DECIMAL(18,4))::DOUBLE AS cost, round_even(avg(n_chars), 1) AS mean_seconds FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""",
)
def eval_summary(spark, d):
    r = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id").select("lang", "source", (F.col("quality") == 1).alias("ok"), (F.col("n_chars") / F.lit(1000.0)).alias("cost"), "n_chars")
    return evals.summarize(r, "lang", "ok", "cost", "n_chars", ["source"])


@query(
    "eval_checks",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'quality' ELSE 'quality,toxic' END AS checks, (quality = 1)::INT + (CASE WHEN toxic = 1 THEN 0 ELSE 1 END)::INT AS passed FROM labels""",
)
def eval_checks(spark, d):
    m = evals.checks({"quality": F.col("quality") == 1, "toxic": F.when(F.col("toxic") != 1, True)})
    x = table(spark, d, "labels").select("doc_id", m.alias("m"))
    return x.select("doc_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("checks"), F.size(F.map_filter("m", lambda _, v: v)).alias("passed"))


@query(
    "report_check",
    """SELECT 0::BIGINT AS only_a, count(*)::BIGINT AS only_b, count(*) = 0 AS same FROM lineitem WHERE l_linenumber = 7""",
)
def report_check(spark, d):
    li = table(spark, d, "lineitem")
    return ops.same_rows(li.where("l_linenumber <> 7"), li)


_PROFILE = rules.Profile(
    roles=[
        rules.Role("metal", "metal work", 30, [["steel", "bolt"], ["brass"]]),
        rules.Role("paint", "paint work", 20, [["red"], ["blue", "gear"]], context=["economy", "small"]),
        rules.Role("plain", "plain work", 10, [["small"], ["widget"]], excluded_context=["promo"]),
    ],
    skills=[rules.Skill("A", 10, ["economy"]), rules.Skill("B", 10, ["standard", "promo"]), rules.Skill("C", 8, ["brand#2", "brand#3"])],
    penalties=[rules.Penalty("large", 4, ["large"]), rules.Penalty("medium only", 8, ["medium"], unless=["brand#1"])],
    blocked_title=["ring", "green"],
    local_places=["asia"],
    commuters=[rules.Commuter("Europe", ["europe"], 40)],
    entry_words=["junior"],
)
_HAS = "regexp_matches({t}, '(^|[^a-z0-9_])({k})([^a-z0-9_]|$)')"


def _has(t: str, *ks: str) -> str:
    return _HAS.format(t=t, k="|".join(ks))


@query(
    "keyword_rules_score",
    f"""WITH p AS (SELECT p_partkey, lower(p_name) AS t, lower(p_type || ' ' || p_brand) AS b, p_size, p_partkey % 5 AS k FROM part),
    f AS (SELECT *, t || ' ' || b AS tb FROM p),
    r AS (SELECT *, CASE WHEN ({_has('t', 'steel')} AND {_has('t', 'bolt')}) OR {_has('t', 'brass')} THEN 'metal'
         WHEN ({_has('t', 'red')} OR ({_has('t', 'blue')} AND {_has('t', 'gear')})) AND {_has('tb', 'economy', 'small')} THEN 'paint'
         WHEN ({_has('t', 'small')} OR {_has('t', 'widget')}) AND NOT {_has('tb', 'promo')} THEN 'plain' END AS role,
       CASE WHEN {_has('t', 'ring')} THEN 'ring' WHEN {_has('t', 'green')} THEN 'green' END AS blocked,
       CASE k WHEN 0 THEN 10 WHEN 1 THEN 15 WHEN 2 THEN 8 ELSE 0 END AS lp, k < 3 AS allowed,
       CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size % 4 END AS years FROM f),
    s AS (SELECT *, CASE role WHEN 'metal' THEN 30 WHEN 'paint' THEN 20 ELSE 10 END
        + least(25, CASE WHEN {_has('tb', 'economy')} THEN 10 ELSE 0 END + CASE WHEN {_has('tb', 'standard', 'promo')} THEN 10 ELSE 0 END + CASE WHEN contains(tb, 'brand#2') OR contains(tb, 'brand#3') THEN 8 ELSE 0 END)
        + CASE years WHEN 1 THEN 14 WHEN 2 THEN 8 WHEN 3 THEN 3 ELSE 20 END + lp
        - CASE WHEN {_has('tb', 'large')} THEN 4 ELSE 0 END - CASE WHEN {_has('tb', 'medium')} AND NOT contains(tb, 'brand#1') THEN 8 ELSE 0 END AS points FROM r)
    SELECT p_partkey, CASE WHEN blocked IS NOT NULL OR role IS NULL OR NOT allowed THEN 'excluded' ELSE 'included' END AS filter_status,
      CASE WHEN blocked IS NOT NULL OR role IS NULL OR NOT allowed THEN 0 ELSE greatest(0, least(100, points)) END::INT AS match_percent,
      CASE WHEN blocked IS NOT NULL OR role IS NULL OR NOT allowed THEN NULL ELSE role END AS role_group,
      CASE WHEN blocked IS NOT NULL THEN 'title word: ' || blocked WHEN role IS NULL THEN 'no role in the title' WHEN NOT allowed THEN 'place does not fit' END AS reason FROM s""",
)
def keyword_rules_score(spark, d):
    k, y = F.col("p_partkey") % 5, F.col("p_size") % 4
    place = F.when(k == 0, "Asia").when(k == 1, "Remote, Germany").when(k == 2, "Europe").otherwise("America")
    remote = F.when(k == 2, "60% remote").otherwise("onsite 0%")
    text = F.concat_ws(" ", "p_type", "p_brand", F.when(y > 0, F.format_string("%d+ years", y)), F.lit("x" * 10))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), place.alias("location"), remote.alias("remote"), F.lit("").alias("employment"), text.alias("description"), F.array().cast("array<string>").alias("career_levels"), F.lit(None).cast("date").alias("published_at"), F.lit(None).cast("int").alias("salary_min"), F.lit(None).cast("int").alias("salary_max"))
    out = rules.score(rows, _PROFILE, F.lit("2024-01-01").cast("date"))
    return out.select("p_partkey", "filter_status", "match_percent", "role_group", F.when(F.col("filter_status") == "excluded", F.get("reasons", F.lit(0))).alias("reason"))


_DEMANDS = rules.Profile(
    roles=[rules.Role("dev", "development", 30, [["developer"]])],
    local_places=["fulda"],
    entry_words=["junior"],
    entry_phrases=["berufseinsteiger"],
    strong_experience=["langjaehrige erfahrung"],
    optional_experience=["von vorteil", "idealerweise"],
    first_experience=["erste erfahrung"],
    applicant_phrases=["du bringst", "sie bringen"],
    degree_patterns=[r"\bmaster\b"],
    travel=["reisebereitschaft 100"],
    boilerplate=["ueber die plattform"],
    domain_keywords=["automotive"],
    salary_minimum=40_000,
    salary_target=60_000,
)
#: What a description asks for, and what the rules make of it: (reason of exclusion or None, rank, points, level).
_ASKED = [
    ("Mindestens 5 Jahre Erfahrung.", "more than 3 years: 5", 99, 0, "excluded"),
    ("Du hast 2 Jahre Erfahrung.", None, 3, 8, "2 years asked for"),
    ("5 Jahre Erfahrung sind von Vorteil.", None, 1, 18, "experience is a plus"),
    ("Unser Team hat 5 Jahre Erfahrung!", None, 1, 20, "no clear requirement"),
    ("Langj\u00e4hrige Erfahrung.", "long experience asked for", 99, 0, "excluded"),
    ("F\u00fcr Berufseinsteiger. Langj\u00e4hrige Erfahrung hat das Haus.", None, 0, 25, "entry level"),
    ("Erste Erfahrung reicht.", None, 0, 25, "first experience is enough"),
    ("Erfahrung in Java.", None, 4, 8, "practical experience asked for"),
    ("Ein Master ist n\u00f6tig.", "advanced degree asked for", 99, 0, "excluded"),
    ("Reisebereitschaft 100 %.", "much travel", 99, 0, "excluded"),
    ("\u00dcber die Plattform: mindestens 5 Jahre Erfahrung.", None, 1, 20, "no clear requirement"),
    ("", None, 4, 8, "no description"),
]
_ASKED_SQL = ", ".join(f"({k}, {'NULL' if why is None else repr(why)}, {rank}, {points}, '{level}')" for k, (_, why, rank, points, level) in enumerate(_ASKED))


@query(
    "experience_rules",
    f"""WITH a(k, why, rank, points, level) AS (VALUES {_ASKED_SQL})
    SELECT p_partkey, CASE WHEN why IS NULL THEN 'included' ELSE 'excluded' END AS filter_status, CASE WHEN why IS NULL THEN 40 + points + CASE WHEN p_partkey % 5 = 0 AND k <> 11 AND k <> 10 THEN 2 ELSE 0 END ELSE 0 END::INT AS match_percent,
      rank::INT AS experience_rank, level AS experience_level, why AS reason FROM part JOIN a ON k = p_partkey % 12""",
)
def experience_rules(spark, d):
    """Descriptions that ask for experience in every way the rules know, a fifth of them with a domain and a salary."""
    k = F.col("p_partkey")
    said = F.element_at(F.array(*[F.lit(t) for t, *_ in _ASKED]), (k % len(_ASKED) + 1).cast("int"))
    more = F.when((k % 5 == 0) & (said != ""), " Automotive. Gehalt 50000 EUR pro Jahr.").otherwise("")
    text = F.when(said != "", F.concat(F.lit("Wir bauen Software. "), said, more)).otherwise("")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Developer "), F.col("p_name")).alias("title"), F.lit("Fulda").alias("location"), F.lit("").alias("remote"), F.lit("").alias("employment"), text.alias("description"), F.array().cast("array<string>").alias("career_levels"), F.lit(None).cast("date").alias("published_at"), F.lit(None).cast("int").alias("salary_min"), F.lit(None).cast("int").alias("salary_max"))
    out = rules.score(rows, _DEMANDS, F.lit("2024-01-01").cast("date"))
    return out.select("p_partkey", "filter_status", "match_percent", "experience_rank", "experience_level", F.when(F.col("filter_status") == "excluded", F.get("reasons", F.lit(0))).alias("reason"))


@query(
    "first_block_reason",
    """SELECT doc_id, CASE WHEN n_chars < 50 THEN 'too short' WHEN contains(text, '***') THEN 'junk' WHEN lang <> 'en' THEN 'language: ' || lang END AS reason FROM documents""",
)
def first_block_reason(spark, d):
    tests = [(F.col("n_chars") < 50, "too short"), (F.col("text").contains("***"), "junk"), (F.col("lang") != "en", F.concat(F.lit("language: "), F.col("lang")))]
    return table(spark, d, "documents").select("doc_id", rules.first_of(tests).alias("reason"))


@query(
    "missed_runs",
    """WITH st AS (SELECT c_custkey AS id, c_custkey % 4 AS missed, c_custkey % 4 < 3 AS active, c_nationkey % 3 AS src FROM customer WHERE c_custkey % 10 <> 1),
    seen AS (SELECT c_custkey AS id, c_nationkey % 3 AS src FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 10 = 1)
    SELECT coalesce(st.id, seen.id) AS id, CASE WHEN st.id IS NULL THEN 'new' WHEN seen.id IS NOT NULL AND active THEN 'known' WHEN seen.id IS NOT NULL THEN 'reactivated'
       WHEN active AND st.src = 0 AND missed + 1 >= 3 THEN 'inactive' WHEN active AND st.src = 0 THEN 'missed' ELSE 'kept' END AS transition,
       CASE WHEN seen.id IS NOT NULL THEN 0 WHEN active AND st.src = 0 THEN missed + 1 ELSE missed END::INT AS missed_runs,
       CASE WHEN seen.id IS NOT NULL THEN true ELSE active AND CASE WHEN st.src = 0 THEN missed + 1 ELSE missed END < 3 END AS active FROM st FULL JOIN seen ON st.id = seen.id""",
)
def missed_runs(spark, d):
    c = table(spark, d, "customer").withColumn("sources", F.array(F.concat(F.lit("s"), (F.col("c_nationkey") % 3).cast("string"))))
    st = c.where("c_custkey % 10 <> 1").select(F.col("c_custkey").alias("id"), F.lit("new").alias("status"), F.lit("2024-01-01").cast("date").alias("first_seen"), F.lit("2024-01-01").cast("date").alias("last_seen"), (F.col("c_custkey") % 4).cast("int").alias("missed_runs"), (F.col("c_custkey") % 4 < 3).alias("active"), "sources")
    seen = c.where("c_custkey % 3 = 0 or c_custkey % 10 = 1").select(F.col("c_custkey").alias("id"), "sources")
    run, ok = F.array(F.lit("s0"), F.lit("s1")), F.array(F.lit("s0"))
    return state.state_step(st, seen, F.lit("2024-01-02").cast("date"), run, ok).select("id", "transition", "missed_runs", "active")


@query(
    "outbox",
    """WITH pend AS (SELECT doc_id AS id FROM documents WHERE doc_id % 4 = 0), snt AS (SELECT doc_id AS id FROM documents WHERE doc_id % 6 = 0),
    res AS (SELECT doc_id AS id, lang = 'en' AS ok, doc_id % 5 <> 0 AS new FROM documents WHERE doc_id % 3 <> 1), p AS (SELECT * FROM pend WHERE id NOT IN (SELECT id FROM snt))
    SELECT coalesce(p.id, res.id) AS id, CASE WHEN p.id IS NOT NULL AND res.id IS NULL THEN 'kept' WHEN p.id IS NOT NULL AND ok THEN 'refreshed' ELSE 'queued' END AS action
    FROM p FULL JOIN res ON p.id = res.id WHERE (p.id IS NOT NULL AND res.id IS NULL) OR (p.id IS NOT NULL AND ok) OR (p.id IS NULL AND ok AND new AND res.id NOT IN (SELECT id FROM snt))""",
)
def outbox(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    pend = docs.where("id % 4 = 0").select("id", F.lit("p").alias("payload"), F.lit(0).alias("attempts"), F.lit("2024-01-01").cast("date").alias("created_at"))
    res = docs.where("id % 3 <> 1").select("id", F.lit("r").alias("payload"), (F.col("lang") == "en").alias("notifiable"), (F.col("id") % 5 != 0).alias("is_new"))
    return state.queue_step(pend, docs.where("id % 6 = 0").select("id"), res, F.lit("2024-01-02").cast("date")).select("id", "action")


@query(
    "detail_cache",
    """WITH l AS (SELECT page_id, page_id % 20 AS age, page_id % 3 = 0 AS ok, page_id % 11 = 0 AS gone, page_id % 4 <> 0 AS cached FROM pages)
    SELECT page_id::VARCHAR AS url, CASE WHEN cached AND age < 7 THEN 'cache' WHEN ok AND NOT gone THEN 'fetched' ELSE 'stale' END AS origin FROM l
    WHERE (cached AND age < 7) OR (NOT gone AND ok) OR (NOT gone AND cached AND age < 14)""",
)
def detail_cache(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), "page_id")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    cache = p.where("page_id % 4 <> 0").select("url", F.lit("c").alias("payload"), (now - F.make_dt_interval((F.col("page_id") % 20).cast("int"))).alias("stored_at"))
    fetched = p.select("url", F.lit("f").alias("payload"), (F.col("page_id") % 3 == 0).alias("ok"), (F.col("page_id") % 11 == 0).alias("unavailable"))
    return sources.with_cache(p.select("url"), cache, fetched, now).select("url", "origin")


@query(
    "alias_closure",
    """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey // 3 AS b FROM orders WHERE o_orderkey > 10 AND o_orderkey < 3000),
    w AS (SELECT a, b FROM e UNION ALL SELECT w.a, e.b FROM w JOIN e ON w.b = e.a)
    SELECT a::BIGINT AS id, min(b)::BIGINT AS root FROM w GROUP BY 1""",
)
def alias_closure(spark, d):
    e = table(spark, d, "orders").where("o_orderkey > 10 and o_orderkey < 3000").select(F.col("o_orderkey").alias("alias"), F.floor(F.col("o_orderkey") / 3).alias("canonical"))
    return resolve.alias_closure(e)


@query("dedup_merge")
def dedup_merge(spark, d):
    """Parts as listings of four sources with spellings that differ: greedy merging in title blocks."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 4
    rows = p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_partkey").alias("ord"),
        F.concat("p_name", F.when(k == 1, " (m/w/d)").when(k == 2, " - Remote").otherwise("")).alias("title"),
        F.concat("p_brand", F.when(k == 3, " GmbH").otherwise("")).alias("company"),
        F.array("p_type").alias("locations"),
        F.array(F.struct(F.concat(F.lit("s"), k.cast("string")).alias("source"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"))).alias("sources"),
        F.repeat(F.lit("x"), F.col("p_size")).alias("description"),
        (k == 2).alias("fully_remote"),
        F.lit(True).alias("is_new"),
    )
    out = resolve.merge_duplicates(rows)
    return out.select("id", F.size("sources").alias("n_sources"), F.length("description").alias("longest"), F.size("locations").alias("n_places"))


@query(
    "chunking",
    """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    r AS (SELECT conv_id, turn, chars, rn, 1 AS n, chars AS total, 0::BIGINT AS chunk FROM o WHERE rn = 1
          UNION ALL SELECT o.conv_id, o.turn, o.chars, o.rn, CASE WHEN r.n = 10 OR r.total + o.chars > 6000 THEN 1 ELSE r.n + 1 END,
                           CASE WHEN r.n = 10 OR r.total + o.chars > 6000 THEN o.chars ELSE r.total + o.chars END, r.chunk + CASE WHEN r.n = 10 OR r.total + o.chars > 6000 THEN 1 ELSE 0 END
                    FROM r JOIN o ON o.conv_id = r.conv_id AND o.rn = r.rn + 1)
    SELECT conv_id, turn, chars, chunk FROM r""",
)
def chunking(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return ledger.chunks(c, "conv_id", "turn", "chars")


@query(
    "closure_queue",
    """WITH st AS (SELECT c_custkey AS id, 'u' || c_custkey AS url FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 <> 0),
    ck AS (SELECT 'u' || c_custkey AS url, TIMESTAMP '2024-02-01 00:00:00' - to_hours((c_custkey % 50)::INT) AS checked_at FROM customer WHERE c_custkey % 2 = 0)
    SELECT id, url FROM st LEFT JOIN ck USING (url) WHERE checked_at IS NULL OR checked_at <= TIMESTAMP '2024-01-31 00:00:00' ORDER BY checked_at NULLS FIRST, url LIMIT 200""",
)
def closure_queue(spark, d):
    c = table(spark, d, "customer")
    url = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    st = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.lit("waiting").alias("status"), F.array(F.lit("s0")).alias("sources"), F.array(url).alias("urls"))
    seen = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    checks = c.where("c_custkey % 2 = 0").select(url.alias("url"), (now - F.make_dt_interval(F.lit(0), (F.col("c_custkey") % 50).cast("int"))).alias("checked_at"), F.lit(True).alias("closed"))
    s0 = F.array(F.lit("s0"))
    return state.closure_candidates(st, seen, checks, now, s0, s0).select("id", "url")
