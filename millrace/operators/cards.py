"""Cards: projections of listings, predicates over their state, rankings, texts for people and for models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import listing as L
from millrace.functions import text as T


def archived(status: Column, record: Column, marker: str = "archived_on") -> Column:
    """Ignored because it went offline: the marker counts by being there, whatever its value."""
    return F.coalesce((status == "ignored") & F.array_contains(F.map_keys(record), marker), F.lit(False))


def has_application(status: Column, history: Column, statuses: Sequence[str]) -> Column:
    """Now in one of the application's statuses, or once."""
    return F.coalesce(status.isin(*statuses), F.lit(False)) | F.coalesce(F.exists(history, lambda e: e["status"].isin(*statuses)), F.lit(False))


def has_manual_state(status: Column, history: Column, note: Column, rating: Column, untouched: Sequence[str] = ("new", "review")) -> Column:
    """Whether dropping an entry could lose something that somebody decided or wrote."""
    decided = status.isNotNull() & ~F.coalesce(status.isin(*untouched), F.lit(False))
    return decided | (F.coalesce(F.size(history), F.lit(0)) > 0) | (F.coalesce(note, F.lit("")) != "") | (F.coalesce(rating, F.lit("")) != "")


def public_documents(documents: Column, kinds: Sequence[str]) -> Column:
    """id, kind and name of the documents that have all three and are of a known kind; storage names stay inside."""
    good = lambda d: (F.coalesce(d["id"], F.lit("")) != "") & F.coalesce(d["kind"].isin(*kinds), F.lit(False)) & (F.coalesce(d["name"], F.lit("")) != "")
    return F.transform(F.filter(F.coalesce(documents, F.array().cast("array<struct<id:string,kind:string,name:string,path:string>>")), good), lambda d: F.struct(d["id"].alias("id"), d["kind"].alias("kind"), d["name"].alias("name")))


def recommendation(cards: DataFrame, facts: Sequence[str], optional: Sequence[str], sources: str = "sources") -> DataFrame:
    """The fields that a decision needs: facts as they are, the first link, all links once, flags without nulls, and the
    optional ones as a map that holds only those with a value."""
    extra = F.map_filter(F.create_map(*[x for c in optional for x in (F.lit(c), F.col(c))]), lambda k, v: F.coalesce(v, F.lit("")) != "")
    links = F.filter(sources, lambda s: F.coalesce(s["url"], F.lit("")) != "")
    return cards.select("id", *facts, F.coalesce("is_new", F.lit(False)).alias("is_new"), F.get(links, F.lit(0))["url"].alias("url"), F.array_distinct(F.transform(links, lambda s: s["url"])).alias("links"), extra.alias("extra"))


def chosen_sources(known: Iterable[str], only: Iterable[str] | None = None, exclude: Iterable[str] = (), groups: dict[str, Iterable[str] | None] | None = None) -> set[str]:
    """Sources that a run searches: the named ones only, or all but the excluded; of a group of optional ones those that
    the settings choose. Unknown names and an empty choice are errors."""
    known = set(known)
    named = set(only) if only is not None else set(exclude)
    if unknown := named - known:
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    chosen = named if only is not None else known - named
    for members, wanted in ((set(m.split()), w) for m, w in (groups or {}).items()):
        if wanted is not None:
            if unknown := set(wanted) - members:
                raise ValueError(f"unknown members: {', '.join(sorted(unknown))}")
            chosen -= members - set(wanted)
    if not chosen:
        raise ValueError("no source is chosen")
    return chosen


#: Fields that an archived listing, and a message about a card, keep (fixed names of the formats).
ARCHIVED = ("id", "title", "company", "locations", "sources", "description_clean", "work_mode", "remote_percentage", "employment_type", "career_levels", "salary_min_eur", "salary_max_eur", "published_at", "fetched_at", "first_seen_at")
TOLD = ("id", "title", "company", "locations", "sources", "work_mode", "remote_percentage", "match_percent", "role_group", "experience_level", "location_precheck", "workflow_status")


def archive_records(listings: DataFrame) -> DataFrame:
    """The archived fields of listings before they are merged, all of which they must have, and nothing else."""
    missing = [c for c in ARCHIVED if c not in listings.columns]
    if missing:
        raise ValueError(f"not in the listings: {', '.join(missing)}")
    return listings.select(*ARCHIVED)


def message_payload(cards: DataFrame, international: Column) -> Column:
    """What a message keeps of a card, as JSON: those of its fields that the cards have, nulls as null, and international, as
    worked out where the cards don't say. No other field gets out."""
    said = F.coalesce(F.col("international"), international) if "international" in cards.columns else international
    return F.to_json(F.struct(*[c for c in TOLD if c in cards.columns], said.alias("international")), {"ignoreNullFields": "false"})


def of_sources(listings: DataFrame, chosen: Iterable[str], source: str = "source") -> DataFrame:
    return listings.where(F.col(source).isin(sorted(chosen)))


def ranked(results: DataFrame) -> DataFrame:
    """Included results: most points first, then the least experience, then by title without case."""
    return results.where("filter_status = 'included'").orderBy(F.desc("match_percent"), "experience_rank", F.lower("title"), "id")


def retained_order(cards: DataFrame) -> DataFrame:
    """Most points first, unknown points last; then by title without case."""
    return cards.orderBy(F.desc(F.coalesce("match_percent", F.lit(-1))), F.lower("title"), "id")


def replace_card(cards: DataFrame, card: DataFrame, urls: str = "urls") -> DataFrame:
    """cards without the one of the same id and without those that share a url with it, and the card itself."""
    met = cards.select("id", F.explode(urls).alias("url")).join(card.select(F.explode(urls).alias("url")), "url", "left_semi").select("id").unionByName(card.select("id")).distinct()
    return retained_order(cards.join(met, "id", "left_anti").unionByName(card))


def overview(applications: DataFrame, open_statuses: Sequence[str]) -> DataFrame:
    """Open applications: those with a next appointment first, the soonest first; then the latest past appointment first;
    then the newest application, or else event. Times are ISO texts, null or empty where there is none."""
    key = lambda c: F.coalesce(c, F.lit(""))
    began = F.coalesce(F.nullif("applied_on", F.lit("")), F.col("last_event_on"))
    return applications.where(F.col("workflow_status").isin(*open_statuses)).orderBy(F.col("next_appointment_at").isNull(), key(F.col("next_appointment_at")), F.desc(key(F.col("last_appointment_at"))), F.desc(key(began)), "id")


def open_first(applications: Column) -> Column:
    """A list of struct(position, open, ...) with the open ones before the others, each in their order."""
    return F.concat(F.filter(applications, lambda a: a["open"]), F.filter(applications, lambda a: ~a["open"]))


def at_most(lines: Column, n: int = 2) -> Column:
    return F.slice(lines, F.lit(1), F.lit(n))


def with_archived(cards: DataFrame, archive: DataFrame, order: list) -> DataFrame:
    """cards, and the archived ones of ids that are not among them, in the order of all."""
    return cards.unionByName(archive.join(cards.select("id"), "id", "left_anti")).orderBy(*order)


def diagnostics(results: DataFrame, shown: Column) -> DataFrame:
    """One row: first finds among the included and the excluded, pending ones, and pending ones that are shown."""
    inside = F.col("filter_status") == "included"
    pending = inside & F.coalesce(F.col("workflow_status") == "new", F.lit(False))
    return results.agg(F.count_if(inside & F.col("is_new")).alias("new_included"), F.count_if(~inside & F.col("is_new")).alias("new_excluded"), F.count_if(pending).alias("pending"), F.count_if(pending & shown).alias("pending_shown"))


def clean_title(title: Column, labels: Sequence[str]) -> Column:
    """A title up to the last gender label in brackets, if something else follows it."""
    trimmed = F.trim(title)
    cut = F.regexp_extract(trimmed, r"^(.*\((?:" + "|".join(labels) + r")\))\s*\S", 1)
    return F.coalesce(F.nullif(cut, F.lit("")), trimmed)


def clean_company(company: Column) -> Column:
    """White space collapsed, and without the suffix of a campaign year (_2024-...)."""
    return F.trim(F.regexp_replace(F.regexp_replace(company, r"\s+", " "), r"_20\d{2}-.+$", ""))


def blank_placeholder(company: Column, placeholders: Sequence[str]) -> Column:
    """Empty where a board names itself as the employer."""
    name = F.trim(F.coalesce(company, F.lit("")))
    return F.when(F.lower(name).isin(*placeholders), "").otherwise(name)


def inferred_source(id_col: Column) -> Column:
    """The part of an id before its colon, where it has one."""
    return F.when(F.contains(id_col, F.lit(":")), F.split(id_col, ":", 2)[0])


def clear_placeholders(state: DataFrame, source: str, placeholders: Sequence[str]) -> DataFrame:
    """state(id, company, source_names, edited, ...) with an empty company where the source's placeholder stands; edited
    rows stay. Rows without names of sources go by the source in their id."""
    names = F.when(F.size(F.coalesce("source_names", F.array().cast("array<string>"))) > 0, F.col("source_names")).otherwise(F.array(inferred_source(F.col("id"))))
    hit = F.array_contains(names, source) & ~F.coalesce("edited", F.lit(False)) & F.lower(F.trim("company")).isin(*placeholders)
    return state.withColumn("company", F.when(F.coalesce(hit, F.lit(False)), "").otherwise(F.col("company")))


def progress(current: Column, total: Column, seconds: Column) -> Column:
    """struct(percent, rate, eta) of work in progress; rate is null before something is done in a measurable time."""
    n = F.greatest(total, F.lit(1))
    done = F.least(F.greatest(current, F.lit(0)), n)
    rate = F.when((done > 0) & (seconds >= 0.05), done / seconds)
    return F.struct(F.bround(done / n * 100, 0).cast("int").alias("percent"), rate.alias("rate"), F.when((seconds >= 5) & (done < n), (n - done) / rate).alias("eta"))


def agent_links(sheet_urls: Column, known: Column) -> Column:
    """Pages that a fact sheet names, once and in order, but for empty and known ones."""
    return F.array_except(F.array_distinct(F.filter(sheet_urls, lambda u: F.coalesce(u, F.lit("")) != "")), known)


def appointment_columns(prefix: str, event: Column) -> list[Column]:
    return [event["scheduled_for"].alias(f"{prefix}_appointment_at"), event["status"].alias(f"{prefix}_appointment_status")]


def remembered(state: DataFrame, texts: tuple[str, str, str] = ("gone", "not seen in this run", "not seen in several runs"), defaults: tuple[str, str] = ("unknown post", "unknown company")) -> DataFrame:
    """Cards of state rows that the snapshot lacks, with a warning about their availability: archived, still active, or
    missed for long. state has id, title, company, urls, status, active, archived."""
    warning = F.when(F.col("archived"), texts[0]).when(F.coalesce("active", F.lit(True)), texts[1]).otherwise(texts[2])
    return state.select("id", F.coalesce("title", F.lit(defaults[0])).alias("title"), F.coalesce("company", F.lit(defaults[1])).alias("company"), F.coalesce(F.get("urls", F.lit(0)), F.lit("")).alias("url"), "status", F.lit(False).alias("is_new"), F.lit(True).alias("snapshot_missing"), warning.alias("warning"))


def message(card: DataFrame, host: str | None = None) -> DataFrame:
    """(id, payload) for notifications: title, link, description and fields as JSON, each within its length."""
    places = F.coalesce(F.nullif(F.array_join("locations", ", "), F.lit("")), F.lit("unknown"))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), T.truncate(value, 1024).alias("value"))
    fields = [
        field("check", F.format_string("new · %s · %d/100", F.coalesce("role_label", F.lit("?")), F.coalesce("match_percent", F.lit(0)))),
        field("level", F.coalesce(F.nullif("experience_level", F.lit("")), F.lit("not recognised"))),
        field("place", F.coalesce(F.nullif("location_precheck", F.lit("")), F.lit("nothing remarkable"))),
    ]
    if host:
        fields.append(field("review", F.concat(F.lit(f"https://{host}/review?job="), "id")))
    about = F.concat(F.lit("**"), F.coalesce(F.nullif("company", F.lit("")), F.lit("unknown company")), F.lit("** "), places, F.lit(" · "), L.display_remote(F.col("remote_percentage"), F.col("work_mode")))
    return card.select("id", F.to_json(F.struct(T.truncate(F.col("title"), 256).alias("title"), F.col("url"), T.truncate(about, 4096).alias("description"), F.array(*fields).alias("fields"))).alias("payload"))


def source_health(reports: DataFrame) -> DataFrame:
    """One row about reports(name, status, new): a line of counts, a line of new finds, a line of warnings."""
    n = lambda s: F.count_if(F.col("status") == s)
    listed = lambda keep, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("name", text.alias("t"))))), lambda x: x["t"]), ", ")
    parts = [F.format_string("%d checked", F.count("*")), F.format_string("%d success", n("success"))] + [F.when(n(s) > 0, F.format_string(f"%d {s}", n(s))) for s in ("partial", "empty", "failed")]
    found = listed(F.col("new") > 0, F.concat("name", F.lit(" "), F.col("new").cast("string")))
    odd = listed(F.col("status").isin("partial", "failed"), F.concat("name", F.lit(" "), "status"))
    return reports.agg(F.concat_ws(" · ", *parts).alias("health"), F.coalesce(F.nullif(found, F.lit("")), F.lit("nothing new")).alias("new_finds"), odd.alias("warnings"))


def prompt(ads: DataFrame, today: Column, searches: int, most: int = 12_000) -> DataFrame:
    """(id, prompt): the facts of each ad line by line, then its text, cut at `most` characters with a note."""
    known = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    pay = F.array_join(F.transform(F.array_compact(F.array("salary_min", "salary_max")), lambda v: F.concat(F.regexp_replace(F.format_number(v, 0), ",", "."), F.lit(" EUR"))), " to ")
    links = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- "), s["source"], F.lit(": "), s["url"])), "\n")
    body = F.trim(F.coalesce("description", F.lit("")))
    text = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n[cut]"))).otherwise(known(body, "(no text)"))
    share = F.when(F.col("remote_percentage").isNotNull(), F.concat(F.lit(", "), F.col("remote_percentage").cast("string"), F.lit(" % remote"))).otherwise("")
    lines = [
        F.concat(F.lit("Date: "), F.date_format(today, "dd.MM.yyyy"), F.lit(f", searches left: {searches}")),
        F.concat(F.lit("Title: "), known(F.col("title"), "")),
        F.concat(F.lit("Company: "), known(F.col("company"), "")),
        F.concat(F.lit("Places: "), known(F.array_join("locations", ", "), "not given")),
        F.concat(F.lit("Mode: "), known(F.col("work_mode"), "unknown"), share),
        F.concat(F.lit("Pay: "), known(pay, "not given")),
        F.concat(F.lit("Links:\n"), known(links, "- none")),
        F.concat(F.lit("Text:\n"), text),
    ]
    return ads.select("id", F.array_join(F.array(*lines), "\n").alias("prompt"))


def checked_limits(values: dict, defaults: dict[str, float], ceilings: dict[str, float], ordered: Sequence[str] = (), may_be_zero: Sequence[str] = ()) -> dict[str, float]:
    """Limits with defaults filled in; unknown names, wrong types, values out of range and a broken order are errors."""
    if unknown := sorted(values.keys() - defaults.keys()):
        raise ValueError(f"unknown limit {unknown[0]}")
    out = dict(defaults)
    for name, value in values.items():
        whole = isinstance(ceilings[name], int)
        if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
            raise ValueError(f"{name} must be {'a whole number' if whole else 'an amount'}")
        if not (value >= 0 if name in may_be_zero else value > 0) or value > ceilings[name]:
            raise ValueError(f"{name} must be {'at least' if name in may_be_zero else 'over'} 0 and at most {ceilings[name]}")
        out[name] = value
    for a, b in zip(ordered, ordered[1:]):
        if out[a] > out[b]:
            raise ValueError(f"{a} <= {b} must hold")
    return out


def eval_cases(decisions: DataFrame, cards: DataFrame, ads: DataFrame, towards: Sequence[str], away: Sequence[str], shown: Column, least_percent: int = 50) -> DataFrame:
    """(id, category, why, decided_on, description): cards that somebody decided for or against, that are shown, entry level
    (rank 0) or over least_percent points, with the text of their ad. decisions(id, status, note, decided_on),
    cards(id, ad_id, experience_rank, match_percent, ...), ads(ad_id, description)."""
    d = decisions.where(F.col("status").isin(*towards, *away))
    c = cards.where(F.col("ad_id").isNotNull() & shown & ((F.col("experience_rank") == 0) | (F.coalesce("match_percent", F.lit(0)) > least_percent)))
    texts = ads.where(F.coalesce("description", F.lit("")) != "").select("ad_id", "description")
    why = F.concat_ws(" – ", F.concat(F.lit("decision: "), "status"), F.nullif("note", F.lit("")))
    return d.join(c.select("id", "ad_id"), "id").join(texts, "ad_id").select("id", F.when(F.col("status").isin(*towards), "for").otherwise("against").alias("category"), why.alias("why"), "decided_on", "description")


def link_entries(state: DataFrame, links: DataFrame) -> DataFrame:
    """state(id, application, documents, linked_ids, urls, locations, active) after links(source_id, target_id): the target,
    an application, takes the source's urls and places and remembers its id; the source goes.

    A link is left out (its target is no application, its source is one or has documents, or is missing). Several
    sources may go to one target; a source that is linked twice goes to the target of the smallest id.
    """
    targets = state.where("application").select(F.col("id").alias("target_id"))
    sources = state.where("not application and not documents").select(F.col("id").alias("source_id"), F.col("urls").alias("s_urls"), F.col("locations").alias("s_locations"), F.col("active").alias("s_active"))
    good = links.where("source_id <> target_id").join(targets, "target_id", "left_semi").groupBy("source_id").agg(F.min("target_id").alias("target_id")).join(sources, "source_id")
    gains = good.groupBy("target_id").agg(F.array_sort(F.collect_set("source_id")).alias("g_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s_urls")))).alias("g_urls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s_locations")))).alias("g_locations"), F.bool_or("s_active").alias("g_active"))
    j = state.join(good.select(F.col("source_id").alias("id")), "id", "left_anti").join(gains.withColumnRenamed("target_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    union = lambda mine, theirs: F.array_union(F.coalesce(mine, none), F.coalesce(theirs, none)).alias(mine)
    return j.select("id", "application", "documents", union("linked_ids", "g_ids"), union("urls", "g_urls"), union("locations", "g_locations"), (F.coalesce("active", F.lit(True)) | F.coalesce("g_active", F.lit(False))).alias("active"))


_LINKS = "array<struct<url:string,name:string>>"


def attach_listings(state: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """state(id, application, documents, linked_ids, urls, names, locations, active, ...) after requests(ord, source_id,
    target_id) in the order of ord, and a report (ord, source_id, target_id, outcome).

    The target, an application, keeps its own columns, remembers the source's id, takes its links (a url with the name of
    its board; a url's first name stays) and places in order, and is active if one of them is. The source's row goes from
    state and stays whole, as the JSON of all of its columns, in the target's linked_entries (a map by id, which may be
    there already). Lists of urls and names that differ in length, as old states have them, are united apart.
    Outcomes: linked; already; same (source and target); no application; no source (missing, or linked by an earlier
    request); an application (the source is one, or has documents).
    """
    none = F.array().cast("array<string>")
    had = F.col("linked_entries") if "linked_entries" in state.columns else F.lit(None).cast("map<string,string>")
    rows = state.withColumn("linked_entries", F.coalesce(had, F.create_map().cast("map<string,string>")))
    own = [c for c in rows.columns if c != "linked_entries"]
    t = rows.select(F.col("id").alias("target_id"), F.col("application").alias("t_application"), F.coalesce("linked_ids", none).alias("t_linked"))
    s = rows.select(F.col("id").alias("source_id"), (F.col("application") | F.coalesce("documents", F.lit(False))).alias("s_taken"), F.struct(*own).alias("entry"))
    asked = requests.select("ord", "source_id", "target_id").join(t, "target_id", "left").join(s, "source_id", "left")
    outcome = (
        F.when(F.col("source_id").eqNullSafe(F.col("target_id")), "same").when(~F.coalesce("t_application", F.lit(False)), "no application").when(F.array_contains("t_linked", F.col("source_id")), "already")
        .when(F.col("entry").isNull(), "no source").when(F.col("s_taken"), "an application").otherwise("linked")
    )
    asked = asked.withColumn("outcome", outcome)
    # of several requests for one source the first that can be met counts; later ones find it linked there, or gone
    earlier = Window.partitionBy("source_id", "outcome").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("taken_by", F.first("target_id").over(earlier))
    again = (F.col("outcome") == "linked") & F.col("taken_by").isNotNull()
    asked = asked.withColumn("outcome", F.when(again & (F.col("taken_by") == F.col("target_id")), "already").when(again, "no source").otherwise(F.col("outcome")))
    done = asked.where("outcome = 'linked'")
    gains = done.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source_id", "entry"))).alias("gains"))
    j = rows.join(done.select(F.col("source_id").alias("id")), "id", "left_anti").join(gains.withColumnRenamed("target_id", "id"), "id", "left")
    each = lambda f: F.coalesce(F.transform("gains", f), F.array())
    of = lambda c: F.flatten(each(lambda g: F.coalesce(g["entry"][c], none)).cast("array<array<string>>"))
    even = (F.size(F.coalesce("urls", none)) == F.size(F.coalesce("names", none))) & F.coalesce(F.forall("gains", lambda g: F.size(F.coalesce(g["entry"]["urls"], none)) == F.size(F.coalesce(g["entry"]["names"], none))), F.lit(True))
    links = A.list_union_pairs(F.col("urls"), F.col("names"), F.filter(of("urls"), lambda u: u.isNotNull()), of("names"))
    links = F.filter(links, lambda x: F.coalesce(x["url"], F.lit("")) != "").cast(_LINKS)
    apart = lambda c: F.array_distinct(F.concat(F.coalesce(c, none), of(c)))
    given = F.col("gains").isNotNull()
    changed = {
        "linked_ids": F.array_distinct(F.concat(F.coalesce("linked_ids", none), F.col("gains.source_id"))),
        "urls": F.when(even, links["url"]).otherwise(apart("urls")),
        "names": F.when(even, links["name"]).otherwise(apart("names")),
        "locations": apart("locations"),
        "active": F.coalesce("active", F.lit(True)) | F.exists("gains", lambda g: F.coalesce(g["entry"]["active"], F.lit(True))),
        "linked_entries": F.map_concat("linked_entries", F.map_from_entries(F.transform("gains", lambda g: F.struct(g["source_id"], F.to_json(g["entry"]))))),
    }
    out = j.select(*(F.when(given, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in [*own, "linked_entries"]))
    return out, asked.select("ord", "source_id", "target_id", "outcome")


def allowed_labels(text: Column, key: str, allowed: Sequence[str]) -> Column:
    """Labels of a comma-separated field in a page's metadata that are among the allowed ones, once and in order."""
    fields = F.regexp_extract_all(text, F.lit(f'"{key}"\\s*:\\s*"([^"]*)"'), F.lit(1))
    labels = F.transform(F.flatten(F.transform(fields, lambda f: F.split(f, ","))), lambda x: F.trim(x))
    return F.array_distinct(F.filter(labels, lambda x: x.isin(*allowed)))


def by_url_identity(source: str, url: Column, generic: Column, own: Column) -> Column:
    """An id made of the source and its own identifier; of the url where a site gives one identifier to every post."""
    from millrace.functions import urls as U

    return F.concat(F.lit(f"{source}:"), F.when(generic, U.identifier_from_url(url)).otherwise(own))
