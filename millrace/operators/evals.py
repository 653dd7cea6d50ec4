"""Grading of results against expected sets, and summaries of graded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(pairs: dict[str, Column]) -> Column:
    """map<string,boolean> of the checks that apply; null ones are left out."""
    whole = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def summarize(results: DataFrame, variant: str, ok: str, cost: str, seconds: str, by: list[str] = ()) -> DataFrame:
    """Runs, passed, share in whole percent (every run counts, aborted ones as wrong), exact cost and mean seconds for
    each variant (and the columns in by)."""
    return results.groupBy(variant, *by).agg(
        F.count("*").alias("runs"),
        F.count_if(F.coalesce(F.col(ok), F.lit(False))).alias("passed"),
        F.bround(F.lit(100.0) * F.count_if(F.coalesce(F.col(ok), F.lit(False))) / F.count("*"), 0).alias("percent"),
        F.sum(F.col(cost).cast("decimal(18,4)")).cast("double").alias("cost"),
        F.bround(F.avg(seconds), 1).alias("mean_seconds"),
    )


def ratio(passed: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit("–")).otherwise(F.format_string("%d/%d (%d %%)", passed, total, F.bround(F.lit(100.0) * passed / total, 0).cast("int")))


def decided_before(cases: DataFrame, decisions: DataFrame, case_day: str, decision_day: str, keys: list[str]) -> DataFrame:
    """Decisions strictly before each case's day (all of them where it has none), matched on keys."""
    j = cases.join(decisions, keys, "left")
    return j.where(F.col(case_day).isNull() | (F.col(decision_day) < F.col(case_day)))


def marks(results: DataFrame, case: str, variant: str, round_: str, verdict: str) -> DataFrame:
    """(case, variant, marks): the verdicts of a case over its rounds, in order; an aborted round is a dash."""
    one = F.struct(F.col(round_), F.coalesce(F.col(verdict), F.lit("–")).alias("v"))
    return results.groupBy(case, variant).agg(F.array_sort(F.collect_list(one)).alias("m")).select(case, variant, F.array_join("m.v", ", ").alias("marks"))


def report(summary: DataFrame, variant: str) -> str:
    """Markdown table of a summary (a row for each variant)."""
    rows = summary.select(variant, ratio(F.col("passed"), F.col("runs")).alias("r"), "cost", "mean_seconds").orderBy(variant).collect()
    return "\n".join(["| variant | passed | cost | seconds |", "|-|-|-|-|", *(f"| {v} | {r} | {c:.3f} | {s} |" for v, r, c, s in rows)])
