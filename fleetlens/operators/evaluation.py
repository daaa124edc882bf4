"""Pass rates, intervals, agreement and comparison of evaluation runs.

results: id, source, tags, status, pass, code_pass, judge_pass, checks (array of
name, passed), iterations, latency_s and one integer column per judged dimension"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens.functions import stats


def family(source) -> Column:
    return (F.when(source.startswith("synthetic"), "synthetic")
            .when(source.isin(ref.HANDWRITTEN_SOURCES), "handwritten"))


def pass_rates(results: DataFrame) -> DataFrame:
    """AG14-AG16: pass rate and interval of all cases, of each family and of each
    source. Cases are counted per source once; the groupings then add up a few rows."""
    ok = results.where("status = 'ok' AND source <> 'trap'")
    fine = ok.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pass"), 1)).alias("passed"),
        F.count(F.when(F.col("code_pass"), 1)).alias("code_passed"))
    names = F.array_compact(F.array(F.lit("all"), family(F.col("source")), F.concat(F.lit("source:"), F.col("source"))))
    groups = fine.withColumn("grp", F.explode(names)).groupBy("grp").agg(
        F.sum("n").alias("n"), F.sum("passed").alias("passed"), F.sum("code_passed").alias("code_passed"))
    p, n = F.col("passed"), F.col("n")
    return groups.select(
        "grp", "n", "passed", F.round(100 * p / n, 1).alias("pass_rate"), F.round(100 * F.col("code_passed") / n, 1).alias("code_rate"),
        stats.wilson_low(p, n).alias("low"), stats.wilson_high(p, n).alias("high"))


def cluster_rates(results: DataFrame) -> DataFrame:
    """AG15: pass rate of the cases that guard each failure cluster."""
    tags = results.where("status = 'ok' AND source <> 'trap'").select("pass", F.explode("tags").alias("tag"))
    return tags.where(F.col("tag").startswith("cluster:")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), stats.pass_rate(F.col("pass")).alias("pass_rate"))


def headline(rates: DataFrame) -> DataFrame:
    """AG22: the lower of the two families' rates with the interval of that family."""
    two = rates.where(F.col("grp").isin("synthetic", "handwritten"))
    pick = F.struct("pass_rate", (F.col("grp") == "handwritten").alias("second"))
    return two.agg(F.min("pass_rate").alias("headline_pass_rate"), F.min_by("grp", pick).alias("headline_group"),
                   F.min_by("low", pick).alias("low"), F.min_by("high", pick).alias("high"))


def failure_tally(results: DataFrame) -> DataFrame:
    """AG20: failed checks by name, most frequent first."""
    rows = results.where("status = 'ok' AND source <> 'trap'").select(F.explode("checks").alias("c")).where("NOT c.passed")
    return rows.groupBy(F.col("c.name").alias("check_name")).agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), "check_name")


def judge_means(results: DataFrame, dimensions: list[str]) -> DataFrame:
    """AG21"""
    means = results.where("status = 'ok' AND source <> 'trap'").agg(*[F.round(F.avg(d), 2).alias(d) for d in dimensions])
    return means.unpivot([], dimensions, "dimension", "mean")


def trap_report(results: DataFrame) -> DataFrame:
    """DP35: how often trap questions were declined, and how often their answer slipped out."""
    return results.where("status = 'ok' AND source = 'trap'").agg(
        F.count(F.lit(1)).alias("n"), stats.pass_rate(F.col("abstained")).alias("abstention_rate"),
        stats.pass_rate(F.col("ungrounded_truth")).alias("ungrounded_truth_rate"))


def diff_runs(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Cases scored in both runs that changed, with what fails now."""
    c = current.where("status = 'ok'").select("id", F.col("pass").alias("_now"), "checks", "judge_pass")
    p = previous.where("status = 'ok'").select("id", F.col("pass").alias("_then"))
    change = F.when(F.col("_then") & ~F.col("_now"), "regression").when(~F.col("_then") & F.col("_now"), "fixed")
    failing = F.transform(F.filter("checks", lambda k: ~k["passed"]), lambda k: k["name"])
    failing = F.when(F.col("judge_pass").eqNullSafe(False), F.concat(failing, F.array(F.lit("judge")))).otherwise(failing)
    return c.join(p, "id", "full_outer").withColumn("change", change).where(F.col("change").isNotNull()).select(
        "id", "change", F.array_join(F.when(F.col("change") == "regression", failing).otherwise(F.array().cast("array<string>")), ",").alias("now_failing"))


def agreement(pairs: DataFrame, dimensions: list[str]) -> DataFrame:
    """AG17/AG18: per dimension the share of equal and of near ratings and the
    weighted kappa. pairs: human_<d> and judge_<d>. One pass, no unpivot of rows."""
    aggregates = []
    for d in dimensions:
        h, j = F.col(f"human_{d}"), F.col(f"judge_{d}")
        aggregates.append(F.struct(
            F.lit(d).alias("dimension"), F.count(F.lit(1)).alias("n"),
            F.round(100 * F.avg((h == j).cast("double")), 1).alias("exact_pct"),
            F.round(100 * F.avg((F.abs(h - j) <= 1).cast("double")), 1).alias("within_one_pct"),
            stats.weighted_kappa(h, j).alias("kappa")).alias(d))
    return pairs.agg(*aggregates).select(F.inline(F.array(*dimensions)))


def observed_counts(pairs: DataFrame, a: str, b: str, categories: list[int]) -> DataFrame:
    """AG19: how often each pair of ratings was given."""
    return pairs.groupBy(a).pivot(b, categories).agg(F.count(F.lit(1))).na.fill(0)


def run_counts(cases: DataFrame, results: DataFrame) -> DataFrame:
    """DP35: cases, scored, infrastructure failures, not yet run."""
    seen = results.agg(F.count(F.lit(1)).alias("_seen"), F.count(F.when(F.col("status") == "ok", 1)).alias("scored"),
                       F.count(F.when(F.col("status") == "infra", 1)).alias("infra"))
    total = cases.agg(F.count(F.lit(1))).scalar()
    return seen.select(total.alias("cases"), "scored", "infra", (total - F.col("_seen")).alias("not_yet_run"))


def report(cases: DataFrame, results: DataFrame, previous: DataFrame, dimensions: list[str]) -> DataFrame:
    """DP35: the whole report as (section, name, value) rows."""
    rates = pass_rates(results)
    counts = run_counts(cases, results)
    changes = diff_runs(results, previous).groupBy("change").agg(F.count(F.lit(1)).alias("n"))

    def rows(section, df, name, value):
        return df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))

    fields = ["cases", "scored", "infra", "not_yet_run"]
    parts = [
        rows("counts", counts.unpivot([], [F.col(f).cast("long").alias(f) for f in fields], "name", "value"), F.col("name"), F.col("value")),
        rows("pass_rate", rates, F.col("grp"), F.col("pass_rate")),
        rows("low", rates, F.col("grp"), F.col("low")), rows("high", rates, F.col("grp"), F.col("high")),
        rows("headline", headline(rates), F.col("headline_group"), F.col("headline_pass_rate")),
        rows("check_failures", failure_tally(results), F.col("check_name"), F.col("failures")),
        rows("judge", judge_means(results, dimensions), F.col("dimension"), F.col("mean")),
        rows("diff", changes, F.col("change"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)
