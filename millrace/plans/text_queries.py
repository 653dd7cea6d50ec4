"""Queries of the scalar functions: text, URLs, dates, amounts, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import numbers as N
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions import variants
from millrace.plans.registry import query
from millrace.session import table

_NORM = "replace(replace(replace(replace(replace(replace(lower({c}), chr(173), ''), chr(8203), ''), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"


def norm_sql(c: str) -> str:
    return _NORM.format(c=f"coalesce({c}, '')")


@query("normalize_text", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query("compact_text", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS compact FROM documents")
def compact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.compact_text(F.col("text")).alias("compact"))


_TOKENS = f"list_filter(regexp_split_to_array({norm_sql('text')}, '[^a-z0-9_à-öø-ÿœ]+'), lambda w: w <> '')"


@query(
    "mainly_english",
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
    n AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('and','the','of','that','with','for','to'))) AS en,
                 len(list_filter(w, lambda x: x IN ('und','der','die','das','mit','nicht','zu'))) AS de FROM t)
    SELECT doc_id, en >= 5 AND en > de * 2 AS english FROM n""",
)
def mainly_english(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.mainly_language(F.col("text"), ("and", "the", "of", "that", "with", "for", "to"), ("und", "der", "die", "das", "mit", "nicht", "zu")).alias("english"))


@query(
    "normalize_title",
    f"""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN ' (m/w/d)' WHEN 1 THEN ' - 100% remote' WHEN 2 THEN ' [REF-7]' WHEN 3 THEN ' | Home Office'
               WHEN 4 THEN ' C++/C#' ELSE ' (Hybrid work)' END AS title FROM part),
    a AS (SELECT p_partkey, regexp_replace({norm_sql('title')}, '\\[[^\\]]*\\]', ' ', 'g') AS t FROM t),
    b AS (SELECT p_partkey, regexp_replace(t, '\\((m/w/d|w/m/d|m/f/d|f/m/d|all genders|alle geschlechter|gn)\\)', ' ', 'g') AS t FROM a),
    e AS (SELECT p_partkey, t, list_last(regexp_split_to_array(t, '[-–—|]| \\(')) AS tail FROM b),
    c AS (SELECT p_partkey, CASE WHEN tail <> t AND trim(replace(replace(tail, ')', ''), '100% remote', 'remote')) IN ('remote','home office','homeoffice','hybrid','hybrid work')
                 THEN t[:length(t) - length(tail)] ELSE t END AS t FROM e)
    SELECT p_partkey, trim(regexp_replace(t, '[^a-z0-9+#.]+', ' ', 'g')) AS title FROM c""",
)
def normalize_title(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in (" (m/w/d)", " - 100% remote", " [REF-7]", " | Home Office", " C++/C#", " (Hybrid work)")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.normalize_title(F.concat("p_name", tail)).alias("title"))


@query(
    "normalize_company",
    r"""WITH t AS (SELECT s_suppkey, 'Bei ' || replace(s_name, '#', ' & Co. KG ') || CASE s_suppkey % 3 WHEN 0 THEN ' GmbH' WHEN 1 THEN ', Inc.' ELSE ' Gruppe AG' END AS n FROM supplier),
    w AS (SELECT s_suppkey, regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g'), '^bei\s+', '')), ' +') AS w FROM t)
    SELECT s_suppkey, array_to_string(list_filter(w, lambda x: x NOT IN ('gmbh','mbh','ag','se','kg','ohg','ug','co','ltd','inc') AND x <> ''), ' ') AS company FROM w""",
)
def normalize_company(spark, d):
    tail = F.element_at(F.array(F.lit(" GmbH"), F.lit(", Inc."), F.lit(" Gruppe AG")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    name = F.concat(F.lit("Bei "), F.replace("s_name", F.lit("#"), F.lit(" & Co. KG ")), tail)
    return table(spark, d, "supplier").select("s_suppkey", T.normalize_company(name).alias("company"))


@query(
    "canonical_url",
    """WITH t AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages),
    q AS (SELECT page_id, split_part(u, '?', 1) AS base, CASE WHEN contains(u, '?') THEN substr(u, strpos(u, '?') + 1) ELSE '' END AS q FROM t),
    k AS (SELECT page_id, base, list_filter(str_split(q, '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')
          AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'msclkid')) AS ps FROM q)
    SELECT page_id, CASE WHEN len(ps) > 0 THEN base || '?' || array_to_string(ps, '&') ELSE base END AS url FROM k""",
)
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))


@query(
    "stable_id",
    """SELECT page_id, 'web:' || CASE WHEN page_id % 3 = 0 THEN 'ext-' || page_id ELSE substr(sha256(url), 1, 20) END AS id,
       lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host,
       regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') AS bare FROM pages""",
)
def stable_id(spark, d):
    pages = table(spark, d, "pages")
    ext = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" ext-"), F.col("page_id").cast("string"))).otherwise("  ")
    return pages.select("page_id", U.stable_id(F.lit("web"), ext, F.col("url")).alias("id"), U.host(F.col("url")).alias("host"), U.bare_url(F.col("url")).alias("bare"))


@query("html_links", """SELECT page_id, array_to_string(list_distinct_ordered, ' ') AS links, len(list_distinct_ordered)::INT AS n FROM (
    SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered
    FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"#]+)"', 1) AS l FROM pages))""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", U.links(F.col("html")).alias("l")).select("page_id", F.array_join("l", " ").alias("links"), F.size("l").alias("n"))


@query("html_text")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(
    "date_parse",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y')
      WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') ELSE 'unknown' END AS s FROM orders)
    SELECT o_orderkey, coalesce(try_strptime(substr(s, 1, 10), '%Y-%m-%d')::DATE, try_strptime(s, '%d.%m.%Y')::DATE) AS day FROM t""",
)
def date_parse(spark, d):
    day = F.col("o_orderdate")
    s = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "dd.MM.yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'")).otherwise("unknown")
    return table(spark, d, "orders").select("o_orderkey", N.parse_date(s).alias("day"))


@query(
    "epoch_parse",
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE ts::DATE END AS day FROM events""",
)
def epoch_parse(spark, d):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    s = F.when(F.col("event_id") % 3 == 0, seconds.cast("string")).when(F.col("event_id") % 3 == 1, (seconds * 1000).cast("string")).otherwise("soon")
    return table(spark, d, "events").select("event_id", N.parse_epoch_date(s).alias("day"))


@query(
    "relative_dates",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN DATE '2024-03-10' WHEN 1 THEN DATE '2024-03-09' WHEN 2 THEN DATE '2024-03-10' - (p_size * 7)::INT
       ELSE DATE '2024-03-10' - 30 END AS day FROM part""",
)
def relative_dates(spark, d):
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, "heute").when(k == 1, "gestern").when(k == 2, F.format_string("vor %d wochen", "p_size")).otherwise("vor einem monat")
    return table(spark, d, "part").select("p_partkey", N.relative_date(label, F.lit("2024-03-10").cast("date")).alias("day"))


@query(
    "percent_extract",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN greatest(10, p_size)::INT WHEN 1 THEN (p_size % 5 + 1)::INT * 20 WHEN 2 THEN (5 - (p_size % 5 + 1))::INT * 20
       WHEN 3 THEN 40 ELSE 0 END AS percent FROM part""",
)
def percent_extract(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_size") % 5 + 1
    text = F.when(k == 0, F.format_string("bis zu %d %% homeoffice moeglich", F.greatest(F.lit(10), F.col("p_size")))).when(k == 1, F.format_string("%d tage pro woche im homeoffice", n)).when(k == 2, F.format_string("%d praesenztage pro woche", n)).when(k == 3, "zwei tage je woche remote").otherwise("im buero")
    return table(spark, d, "part").select("p_partkey", N.remote_percent(T.normalize_text(text)).alias("percent"))


@query(
    "years_extract",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::INT WHEN 1 THEN (p_size + 2)::INT WHEN 2 THEN (p_size + 1)::INT WHEN 3 THEN p_size::INT ELSE 0 END AS years FROM part""",
)
def years_extract(spark, d):
    from millrace.operators.rules import required_years

    k, n = F.col("p_partkey") % 5, F.col("p_size")
    text = F.when(k == 0, F.format_string("mindestens %d jahre berufserfahrung", n)).when(k == 1, F.format_string("%d bis %d jahre erfahrung", n, n + 2)).when(k == 2, F.format_string("more than %d years of experience", n)).when(k == 3, F.format_string("%d+ years in sales", n)).otherwise("seit 20 jahren am markt")
    return table(spark, d, "part").select("p_partkey", required_years(T.normalize_text(text)).alias("years"))


@query(
    "salary_extract",
    """WITH t AS (SELECT c_custkey, (20000 + c_custkey % 150000)::BIGINT AS low FROM customer)
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN low WHEN 1 THEN low WHEN 2 THEN (low // 1000) * 1000 ELSE NULL END AS low,
           CASE c_custkey % 4 WHEN 0 THEN low + 5000 WHEN 1 THEN low WHEN 2 THEN (low // 1000) * 1000 ELSE NULL END AS high FROM t""",
)
def salary_extract(spark, d):
    low, k = F.lit(20000) + F.col("c_custkey") % 150000, F.col("c_custkey") % 4
    text = F.when(k == 0, F.format_string("wir zahlen %d - %d EUR", low, low + 5000)).when(k == 1, F.format_string("Jahresgehalt: %d Euro", low)).when(k == 2, F.format_string("Gehalt bis %dk", F.floor(low / 1000))).otherwise(F.format_string("Postfach %d", low))
    pay = N.annual_salary(T.normalize_text(text))
    return table(spark, d, "customer").select("c_custkey", pay["low"].alias("low"), pay["high"].alias("high"))


@query(
    "ordered_union",
    """WITH t AS (SELECT o_orderkey, [o_orderstatus, o_orderpriority, ''] AS a, ['O', o_orderpriority, NULL, 'x'] AS b FROM orders),
    u AS (SELECT o_orderkey, list_filter(list_concat(a, b), lambda x: x IS NOT NULL AND x <> '') AS l FROM t)
    SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS merged FROM u""",
)
def ordered_union(spark, d):
    a = F.array("o_orderstatus", "o_orderpriority", F.lit(""))
    b = F.array(F.lit("O"), F.col("o_orderpriority"), F.lit(None).cast("string"), F.lit("x"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(A.ordered_union(a, b), "|").alias("merged"))


@query(
    "pair_explode",
    """WITH t AS (SELECT o_orderkey, list_filter(['a' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'b' END, 'c'], lambda x: true) AS urls, [o_orderstatus, NULL] AS names FROM orders),
    e AS (SELECT o_orderkey, unnest(range(1, 4)) AS i, urls, names FROM t)
    SELECT o_orderkey, (i - 1)::INT AS position, urls[i] AS url, names[i] AS name FROM e WHERE urls[i] IS NOT NULL OR names[i] IS NOT NULL""",
)
def pair_explode(spark, d):
    urls = F.array(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 2 == 0, "b"), F.lit("c"))
    zipped = F.arrays_zip(urls.alias("url"), F.array(F.col("o_orderstatus"), F.lit(None).cast("string")).alias("name"))
    rows = table(spark, d, "orders").select("o_orderkey", F.posexplode(zipped).alias("position", "x"))
    return rows.select("o_orderkey", "position", "x.url", "x.name").where("url is not null or name is not null")


@query(
    "json_digest",
    """SELECT c_custkey, substr(sha256(array_to_string([c_name, coalesce(c_nationkey::VARCHAR, chr(0)), c_mktsegment], chr(31))), 1, 12) AS digest FROM customer""",
)
def json_digest(spark, d):
    return table(spark, d, "customer").select("c_custkey", A.digest(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("digest"))


@query(
    "ops_bag_expand",
    """WITH t AS (SELECT event_type, json_keys(props) AS ks, props FROM events),
    e AS (SELECT event_type, unnest(ks) AS key, props FROM t)
    SELECT event_type, key, sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT))::BIGINT AS total FROM e GROUP BY ALL HAVING sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) > 0""",
)
def ops_bag_expand(spark, d):
    events = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,long>")).alias("key", "v"))
    return events.groupBy("event_type", "key").agg(F.sum("v").alias("total")).where("total > 0")


@query(
    "record_split",
    """WITH t AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS et FROM events)
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'status' ELSE 'status,title' END AS present, 1::INT AS n_extra FROM t""",
)
def record_split(spark, d):
    rec = F.create_map(F.lit("status"), F.when(F.col("event_id") % 2 != 0, F.col("event_type")), F.lit("note"), F.col("user_id").cast("string"))
    rec = F.map_concat(rec, F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("title"), F.lit("t"))).otherwise(F.create_map().cast("map<string,string>")))
    x = table(spark, d, "events").select("event_id", A.split_record(rec, ("title", "status", "company")).alias("x"))
    return x.select("event_id", F.array_join("x.present", ",").alias("present"), F.size("x.extra").alias("n_extra"))


@query(
    "formats",
    """SELECT o_orderkey, replace(format('{:,}', round(o_totalprice)::BIGINT), ',', '.') AS count_text,
       CASE WHEN length(o_orderpriority) > 6 THEN rtrim(substr(o_orderpriority, 1, 5)) || '…' ELSE o_orderpriority END AS short,
       CASE WHEN o_orderkey % 7200 < 60 THEN (o_orderkey % 7200) || ' s' ELSE (o_orderkey % 7200) // 60 || ' min ' || (o_orderkey % 7200) % 60 || ' s' END AS lasted FROM orders""",
)
def formats(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", T.format_count(F.round("o_totalprice").cast("long")).alias("count_text"), T.truncate(F.col("o_orderpriority"), 6).alias("short"), T.format_duration(F.col("o_orderkey") % 7200).alias("lasted"))


_SHEET = {
    "type": "object",
    "required": ["id", "role", "turn", "tags"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 0},
        "role": {"type": "string", "enum": ["user", "assistant"]},
        "turn": {"type": "integer", "maximum": 4},
        "text": {"type": ["string", "null"], "maxLength": 200},
        "tags": {"type": "array", "maxItems": 2, "items": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "pattern": "^t", "minLength": 2}}}},
    },
}


@query(
    "schema_faults",
    """WITH c AS (SELECT conv_id, turn, text, coalesce(conv_id, 0) * 3 + coalesce(turn, 0) AS k, CASE WHEN (coalesce(conv_id, 0) * 3 + coalesce(turn, 0)) % 6 = 0 THEN 'robot' ELSE 'user' END AS role FROM conversations)
    SELECT conv_id, turn, '$.id' AS path, 'minimum' AS rule FROM c WHERE k % 4 = 0 AND k > 0
    UNION ALL SELECT conv_id, turn, '$.role', 'required' FROM c WHERE k % 5 = 0
    UNION ALL SELECT conv_id, turn, '$.role', 'enum' FROM c WHERE k % 5 <> 0 AND role = 'robot'
    UNION ALL SELECT conv_id, turn, '$.turn', 'type' FROM c WHERE k % 3 = 0
    UNION ALL SELECT conv_id, turn, '$.turn', 'maximum' FROM c WHERE k % 3 <> 0 AND k % 7 > 4
    UNION ALL SELECT conv_id, turn, '$.text', 'maxLength' FROM c WHERE length(text) > 200
    UNION ALL SELECT conv_id, turn, '$.tags', 'required' FROM c WHERE k % 8 = 0
    UNION ALL SELECT conv_id, turn, '$.tags', 'maxItems' FROM c WHERE k % 8 = 3
    UNION ALL SELECT conv_id, turn, '$.tags[1].name', 'pattern' FROM c WHERE k % 8 = 3
    UNION ALL SELECT conv_id, turn, '$.tags[2].name', 'minLength' FROM c WHERE k % 8 = 3
    UNION ALL SELECT conv_id, turn, '$.tags[0].name', 'required' FROM c WHERE k % 8 = 5
    UNION ALL SELECT conv_id, turn, '$.more', 'additionalProperties' FROM c WHERE k % 9 = 1""",
)
def schema_faults(spark, d):
    """Turns as documents with faults by their number."""
    rows = table(spark, d, "conversations").withColumn("k", F.coalesce("conv_id", F.lit(0)) * 3 + F.coalesce("turn", F.lit(0)))
    k = F.col("k")
    tag = lambda x: F.struct(F.lit(x).cast("string").alias("name"))
    tags = F.when(k % 8 == 0, None).when(k % 8 == 3, F.array(tag("tx"), tag("no"), tag("t"))).when(k % 8 == 5, F.array(tag(None), tag("ty"))).otherwise(F.array(tag("tz")))
    turn = F.when(k % 3 == 0, F.concat(F.lit('"'), (k % 7).cast("string"), F.lit('"'))).otherwise((k % 7).cast("string"))
    fields = F.struct(F.when(k % 4 == 0, -k).otherwise(k).alias("id"), F.when(k % 5 != 0, F.when(k % 6 == 0, "robot").otherwise("user")).alias("role"), F.col("text"), tags.alias("tags"), F.when(k % 9 == 1, True).alias("more"))
    document = F.concat(F.lit('{"turn":'), turn, F.lit(","), F.substring(F.to_json(fields), 2, 1 << 30))
    return variants.faults(rows.select("conv_id", "turn", document.alias("document")), "document", _SHEET)


@query(
    "typed_objects",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '$' WHEN 1 THEN '$.@graph[1]' WHEN 2 THEN '$.a.b[0][0]' ELSE '$.list[0]' END AS path, url AS title FROM pages WHERE page_id % 5 <> 0
    UNION ALL SELECT page_id, '$.list[1].inner', 'inner' FROM pages WHERE page_id % 5 <> 0 AND page_id % 4 = 3""",
)
def typed_objects(spark, d):
    """Postings at several depths of documents made from pages, found in the JVM."""
    k, url = F.col("page_id"), F.to_json(F.struct(F.col("url").alias("title")))
    posting = F.concat(F.lit('{"@type":'), F.when(k % 5 == 0, '"Thing"').when(k % 3 == 0, '["Thing","JobPosting"]').otherwise('"JobPosting"'), F.lit(","), F.substring(url, 2, 1 << 30))
    inner = F.when(k % 5 != 0, '{"@type":"JobPosting","title":"inner"}').otherwise("null")
    document = F.when(k % 4 == 0, posting).when(k % 4 == 1, F.concat(F.lit('{"@graph":[{"@type":"Other"},'), posting, F.lit("]}"))).when(k % 4 == 2, F.concat(F.lit('{"a":{"b":[['), posting, F.lit("]]}}"))).otherwise(F.concat(F.lit('{"list":['), posting, F.lit(',{"inner":'), inner, F.lit("}]}")))
    found = variants.typed_objects(table(spark, d, "pages").select("page_id", document.alias("document")), "document", ["JobPosting"])
    return found.select("page_id", "path", F.try_variant_get("object", "$.title", "string").alias("title"))
