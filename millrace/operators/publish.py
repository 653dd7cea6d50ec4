"""What is shown and sent: recommendations, visibility, review filters, notifications, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as T


def region_allows(labels: Column, country: Column, home: tuple[str, ...], regions: tuple[str, ...]) -> Column:
    """Whether a remote post may be done from home: its country code decides; else one of its region labels must be
    home or a region around it; no restriction allows it."""
    code = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(labels, F.lit(""))), r"[,;/|]+"), lambda x: F.trim(x)), lambda x: x != "")
    ok = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in (*home, *regions)]))
    return F.when(code != "", code.isin(*home)).when(F.size(parts) == 0, True).otherwise(ok)


def international(locations: Column, sources: Column, text: Column, terms: tuple[str, ...], countries: tuple[str, ...], feeds: tuple[str, ...], own: tuple[str, ...], other: tuple[str, ...]) -> Column:
    """Broad scopes by word, foreign countries by name, or posts that only international feeds carry and that are mainly
    English."""
    place = F.lower(F.array_join(F.filter(locations, lambda x: F.trim(x) != ""), " "))
    words = F.split(place, r"[^a-zäöüß]+")
    broad = F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms]))
    abroad = T.contains_substring(place, countries) if countries else F.lit(False)
    only_feeds = (F.size(sources) > 0) & (F.size(F.array_except(sources, F.array(*[F.lit(f) for f in feeds]))) == 0)
    return broad | abroad | (only_feeds & T.mainly_language(text, own, other))


def visible(df_status: Column, precheck: Column, is_international: Column, by_hand: Column, hidden_prefix: str = "entry level, hybrid elsewhere") -> Column:
    """Shown by default: entered by hand, or neither international nor an entry-level post elsewhere."""
    return by_hand | (~is_international & ~F.coalesce(F.startswith(precheck, F.lit(hidden_prefix)), F.lit(False)))


def notifiable(status: Column, is_international: Column, shown: Column, statuses: tuple[str, ...] = ("new", "interesting")) -> Column:
    return F.coalesce(status, F.lit("new")).isin(*statuses) & ~F.coalesce(is_international, F.lit(False)) & shown


def review_filter(cards: DataFrame, status: str | None = None, role: str | None = None, query: str | None = None, show_international: bool = False, show_elsewhere: bool = False) -> DataFrame:
    """Cards that the filters let through; None means no filter. Those entered by hand pass the last two."""
    out = cards
    if status:
        out = out.where(F.col("status") == status)
    if role:
        out = out.where(F.col("role_group") == role)
    if query and query.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "title", "company")), F.lit(query.strip().lower())))
    if not show_international:
        out = out.where(F.col("by_hand") | ~F.col("international"))
    if not show_elsewhere:
        out = out.where(F.col("by_hand") | ~F.coalesce(F.startswith("location_precheck", F.lit("entry level, hybrid elsewhere")), F.lit(False)))
    return out


def source_links(sources: Column) -> Column:
    """Links once by URL, the first label stays; links without URL go."""
    kept = F.filter(sources, lambda s: F.coalesce(s["url"], F.lit("")) != "")
    return A.distinct_by(kept, lambda s: s["url"], "struct<source:string,url:string>")


def new_by_source(listings: DataFrame, new: Column, sources: str = "sources") -> DataFrame:
    """(source, n) of new listings; one with several sources counts for each."""
    return listings.where(new).select(F.explode(F.array_distinct(F.transform(sources, lambda s: s["source"]))).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def run_summary(listings: DataFrame, reports: DataFrame, run_id: str) -> DataFrame:
    """One row with a JSON payload: totals, new ones by source, and the sources' states."""
    totals = listings.agg(F.count("*").alias("jobs_total"), F.count_if("is_new").alias("jobs_new"))
    by = new_by_source(listings, F.col("is_new")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("new_by_source"))
    states = reports.agg(F.count_if(F.col("status") == "partial").alias("sources_partial"), F.count_if(F.col("status") == "failed").alias("sources_failed"))
    one = totals.crossJoin(F.broadcast(by)).crossJoin(F.broadcast(states))  # one row each, by their aggregates
    return one.select(F.to_json(F.struct(F.lit(run_id).alias("run_id"), *one.columns)).alias("payload"))


def past_decisions(rows: DataFrame, current_id: str, company: str | None, keywords: list[str], n: int = 10) -> DataFrame:
    """Decisions on the same company, else on titles with one of the keywords: companies first, newest first, n at most."""
    keys = [k.strip() for k in keywords[:5] if len(k.strip()) >= 3]
    same = T.companies_match(T.normalize_company(F.lit(company or "")), T.normalize_company(F.col("company")))
    title = T.contains_any(T.normalize_title(F.col("title")), keys)
    kind = F.when(same, "company").when(title, "title")
    return rows.where(F.col("id") != current_id).withColumn("match", kind).where("match is not null").orderBy(F.col("match") != "company", F.desc_nulls_last("decided_on"), "id").limit(n)
