import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import funnel, ledger, ops, resolve, review, rules, state

LISTING = "id string, ord int, title string, company string, locations array<string>, sources array<struct<source:string,url:string>>, description string, fully_remote boolean, is_new boolean"


def listing(i, title, company, places, source, text="", remote=False):
    return (f"l{i}", i, title, company, places, [(source, f"u{i}")], text, remote, False)


def merged(spark, rows):
    return {r["id"]: r for r in resolve.merge_duplicates(spark.createDataFrame(rows, LISTING)).collect()}


def test_merging_over_sources(spark):
    got = merged(
        spark,
        [
            listing(0, "Dev (m/w/d)", "Acme GmbH", ["Fulda"], "a", "short"),
            listing(1, "dev", "ACME", ["36037 Fulda", "Ulm"], "b", "much longer"),
            listing(2, "Dev", "Acme", ["Fulda"], "a"),  # same source as the merged row
            listing(3, "Dev", "Other", ["Fulda"], "c"),
            listing(4, "Dev", "", ["Fulda"], "d"),
            listing(5, "Dev", "Acme AG", ["Bonn"], "e"),  # no place in common
            listing(6, "Ops", "Acme", [], "a", remote=True),
            listing(7, "Ops", "Acme", [], "b", remote=True),
        ],
    )
    assert set(got) == {"l0", "l2", "l3", "l4", "l5", "l6"}
    assert got["l0"]["description"] == "much longer" and got["l0"]["locations"] == ["Fulda", "36037 Fulda", "Ulm"]
    assert [s["source"] for s in got["l0"]["sources"]] == ["a", "b"] and len(got["l6"]["sources"]) == 2


def test_merging_is_greedy_in_input_order(spark):
    rows = [listing(0, "Dev", "Siemens", ["Fulda"], "a"), listing(1, "Dev", "Siemens", ["Ulm"], "b"), listing(2, "Dev", "Siemens Energy", ["Fulda", "Ulm"], "c")]
    got = merged(spark, rows)
    assert len(got["l0"]["sources"]) == 2 and len(got["l1"]["sources"]) == 1 and "l2" not in got


def test_merging_nothing(spark):
    assert resolve.merge_duplicates(spark.createDataFrame([], LISTING)).count() == 0


def test_alias_chains_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s")], "alias string, canonical string")
    got = dict(resolve.alias_closure(edges).collect())
    assert got == {"a": "d", "b": "d", "c": "d", "x": "x", "y": "x", "z": "x", "w": "x"}


PROFILE = rules.Profile(
    roles=[rules.Role("py", "Python", 30, [["python", "developer"]]), rules.Role("sap", "SAP", 14, [["sap"]], entry_only=True)],
    skills=[rules.Skill("Python", 20, ["python"]), rules.Skill("SQL", 10, ["sql"])],
    penalties=[rules.Penalty("part time", 4, ["teilzeit"], ["vollzeit"], substring=True)],
    blocked_title=["senior", "head of"],
    entry_exceptions=["senior"],
    local_places=["fulda"],
    commuters=[rules.Commuter("Bonn", ["bonn"], 60, ["bad bonn"])],
    foreign_only=["usa"],
    strong_experience=["mehrjaehrige erfahrung"],
    travel=["hohe reisebereitschaft"],
)


def scored(spark, **kw):
    base = {"title": "Python Developer", "location": "Fulda", "remote": "", "employment": "", "description": "x" * 450, "career_levels": [], "published_at": None, "salary_min": None, "salary_max": None} | kw
    schema = "title string, location string, remote string, employment string, description string, career_levels array<string>, published_at date, salary_min int, salary_max int"
    return rules.score(spark.createDataFrame([tuple(base.values())], schema), PROFILE, F.lit("2024-03-01").cast("date")).first()


def test_scores(spark):
    r = scored(spark)
    assert (r["filter_status"], r["match_percent"], r["role_group"]) == ("included", 30 + 20 + 20 + 10, "py")
    assert scored(spark, description="sql " * 200)["match_percent"] == 30 + 25 + 20 + 10
    assert scored(spark, description="Teilzeit " * 99)["match_percent"] == 76


def test_first_failing_rule_gives_the_reason(spark):
    why = lambda **kw: scored(spark, **kw)["reasons"]
    assert why(title="Senior Python Developer", published_at=dt.date(2023, 12, 1)) == ["older than 60 days: 01.12.2023"]
    assert scored(spark, published_at=dt.date(2024, 1, 1))["filter_status"] == "included"  # 60 days to the day
    assert why(title="Senior Python Developer") == ["title word: senior"]
    assert scored(spark, title="Junior/Senior Python Developer")["filter_status"] == "included"
    assert why(title="Gärtner") == ["no role in the title"]
    assert why(career_levels=["Senior"]) == ["portal level: Senior"]
    assert why(description="5+ years in sales, " + "x" * 450) == ["more than 3 years: 5"]
    assert why(description="mehrjährige Erfahrung " * 40) == ["long experience asked for"]
    assert why(description="hohe Reisebereitschaft " * 40) == ["much travel"]
    assert why(location="Köln") == ["place does not fit"]
    assert why(title="SAP Berater") == ["no role in the title"]
    r = scored(spark, location="Köln")
    assert (r["match_percent"], r["experience_rank"], r["role_group"]) == (0, 99, None)


def test_optional_and_employer_clauses_do_not_count(spark):
    from dataclasses import replace

    p = replace(PROFILE, optional_experience=["von vorteil"], applicant_phrases=["du hast"])
    years = lambda x: spark.range(1).select(rules.required_years(rules.demanding_clauses(F.lit(x), p.optional_experience, p.applicant_phrases))).first()[0]
    assert years("5 jahre berufserfahrung von vorteil. 2 jahre erfahrung") == 2
    assert years("unser team hat 20 jahre erfahrung; du hast 3 jahre erfahrung") == 3
    assert years("unser team hat 20 jahre erfahrung, und du hast 4 jahre erfahrung") == 20
    assert years("mehr als 3 jahre erfahrung") == 4 and years("0 jahre erfahrung") == 0 and years("seit 20 jahren am markt") == 0


def test_ladder_of_experience(spark):
    from dataclasses import replace

    p = replace(PROFILE, optional_experience=["von vorteil"], first_experience=["erste erfahrung"])

    def rung(body):
        e = spark.range(1).select(rules.experience(F.lit("dev"), F.lit(body), rules.required_years(F.lit(body)), F.lit("x" * 500), p).alias("e")).first()["e"]
        return e["rank"], e["points"]

    assert rung("3-5 years of experience")[0] == 6 - 1 or rung("2 bis 3 jahre erfahrung") == (4, 3)
    assert rung("erste erfahrung mit sql reicht") == (0, 25)
    assert rung("du bringst viel erfahrung aus projekten") == rung("solid experience") == rung("erfahrung mit sql") == rung("experienced in sql") == (4, 8)
    assert rung("erfahrung mit sql von vorteil") == (1, 18)
    assert rung("we experience growth") == (1, 20)


def test_places(spark):
    assert scored(spark, location="Bonn", remote="60%")["location_precheck"] == "Bonn with 60% remote"
    assert scored(spark, location="Bad Bonn", remote="60%")["filter_status"] == "excluded"
    assert scored(spark, location="USA", remote="100%")["reasons"] == ["remote, but not from home"]
    assert scored(spark, location="Anywhere", remote="100%")["location_precheck"] == "remote from home"
    assert scored(spark, title="Junior Python Developer", location="Köln", remote="hybrid")["location_precheck"] == "entry level, hybrid elsewhere"


def test_manual_override(spark):
    df = spark.createDataFrame([(["manual"], "excluded", ["why"]), (["feed"], "excluded", ["why"])], "source_names array<string>, filter_status string, reasons array<string>")
    assert [tuple(r) for r in rules.with_manual_override(df).select("filter_status", "prefilter_warning").collect()] == [("included", "why"), ("excluded", None)]


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_state_counts_misses_only_where_all_searched_sources_succeeded(spark):
    ddl = "id string, status string, first_seen int, last_seen int, missed_runs int, active boolean, sources array<string>"
    st = spark.createDataFrame([("a", "new", 1, 1, 2, True, ["x"]), ("b", "new", 1, 1, 2, True, ["x", "y"]), ("c", "applied", 1, 1, 3, False, ["x"]), ("d", "new", 1, 1, 0, True, ["z"])], ddl)
    seen = spark.createDataFrame([("c", ["x"]), ("e", ["x"])], "id string, sources array<string>")
    got = {r["id"]: (r["transition"], r["missed_runs"], r["active"], r["status"]) for r in state.state_step(st, seen, F.lit(2), arr("x", "y"), arr("x")).collect()}
    assert got == {"a": ("inactive", 3, False, "new"), "b": ("kept", 2, True, "new"), "c": ("reactivated", 0, True, "applied"), "d": ("kept", 0, True, "new"), "e": ("new", 0, True, "new")}


def test_changes_and_their_application(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, v string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", 1)], "k int, v string, n int")
    diff = state.changes(a, b, ["k"])
    assert {r["k"]: r["change"] for r in diff.collect()} == {2: "update", 3: "delete", 4: "insert"}
    assert ops.same_rows(state.apply_changes(a, diff, ["k"]), b).first()["same"]


def test_closing_needs_every_url_and_an_unchanged_row(spark):
    ddl = "id string, status string, urls array<string>"
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    then = spark.createDataFrame([("a", "waiting", ["u", "v"]), ("b", "waiting", ["w"]), ("c", "waiting", ["w"])], ddl)
    cur = spark.createDataFrame([("a", "waiting", ["u", "v"]), ("b", "applied", ["w"]), ("c", "waiting", ["w"])], ddl)
    checks = spark.createDataFrame([("u", "2024-01-01 12:00:00", True), ("v", "2023-12-31 12:00:00", True), ("w", "2024-01-01 12:00:00", True)], "url string, t string, closed boolean").withColumn("checked_at", F.col("t").cast("timestamp"))
    assert [r["id"] for r in state.close_confirmed(cur, then, checks, now).collect()] == ["c"]


def test_berlin_midnight_bounds_the_day(spark):
    df = spark.createDataFrame([("2024-01-09 22:59:59", 1), ("2024-01-09 23:00:00", 2), ("2023-12-31 22:30:00", 4), ("2023-12-31 23:30:00", 8)], "t string, v int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    r = ledger.spent(df, "t", "v", F.lit("2024-01-10 12:00:00").cast("timestamp")).first()
    assert (r["spent_today"], r["spent_month"]) == (2, 11)


def test_budget_overshoots_by_one_call(spark):
    df = spark.createDataFrame([(1, i, 4.0) for i in range(5)], "k int, i int, cost double")
    assert sorted(r["i"] for r in ledger.within_budget(df, ["k"], ["i"], "cost", 8).collect()) == [0, 1]


def test_chunks(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([3, 3, 3, 9, 1])], "k int, i int, s int")
    assert [r["chunk"] for r in ledger.chunks(df, "k", "i", "s", 2, 7).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_balanced_sample_spills_over(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(20)], "i int, y int")
    got = review.balanced_sample(df, "y", "i", 10, "s").collect()
    assert len(got) == 10 and sum(r["y"] for r in got) == 3


def test_history_puts_unknown_dates_first(spark):
    df = spark.createDataFrame([("k", "a", dt.date(2024, 1, 2), 0), ("k", "b", None, 1), ("k", "c", dt.date(2024, 1, 1), 2)], "k string, s string, d date, p int")
    h = funnel.ordered_history(df, "k", "s", "d", "p").first()["history"]
    assert [e["status"] for e in h] == ["b", "c", "a"]


def test_same_company_pairs_equal_the_full_comparison(spark):
    from millrace.functions import text as T

    names = ["Siemens", "Siemens Energy", "Energy Siemens GmbH", "Umbra Group", "Umbra Engineering Group", "SAP", "SAP Labs", "", "Acme", "Acme Tools", "Tools of Acme"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = {(r["a_i"], r["b_i"]) for r in review.same_company(df, df, "n").collect()}
    keyed = df.select("i", T.normalize_company(F.col("n")).alias("k"))
    want = keyed.alias("a").crossJoin(keyed.alias("b")).where(T.companies_match(F.col("a.k"), F.col("b.k"))).select("a.i", "b.i")
    assert got == {tuple(r) for r in want.collect()}


def test_same_company_counts_equal_the_pairs(spark):
    names = ["Siemens", "Siemens", "Siemens Energy", "Energy Siemens GmbH", "Umbra Group", "Umbra Engineering Group", "SAP", "SAP Labs", "", "Acme", "Acme Tools", "Lone"]
    df = spark.createDataFrame([*enumerate(names), (0, "Siemens Energy"), (None, "Acme")], "i int, n string")
    want = review.same_company(df, df, "n").where("a_i <> b_i").groupBy("a_i").count()
    got = {(r["i"], r["n"]) for r in review.same_company_counts(df, "i", "n").collect()}
    assert got == {tuple(r) for r in want.collect()} and all(i != 11 for i, _ in got)


def test_same_company_names_do_not_meet_by_a_frequent_word_alone(spark):
    df = spark.range(3000).select(F.col("id").alias("i"), F.concat(F.lit("Firm "), F.col("id").cast("string")).alias("n"))
    pairs = review.same_company(df, df, "n").where("a_i <> b_i")
    assert pairs.count() == 0
    joins = [p for p in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in p]
    assert len(joins) == 4
    counted = review.same_company_counts(spark.range(40_000).select(F.col("id").alias("i"), F.lit("Acme AG").alias("n")), "i", "n")
    assert counted.agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (39_999, 39_999, 40_000)
