"""Reading quality: flagging, guarding, re-flagging and rule audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import readings as fr
from fleetlens.operators import skew


def flag_readings(telemetry: DataFrame, ranges: DataFrame) -> DataFrame:
    """PF8/J9: adds quality_flag; works on batch and stream (ST1). `ranges` has
    one row per metric; while it is small it goes to every task."""
    limits = ranges.select("metric_name", F.col("min_value").alias("_lo"), F.col("max_value").alias("_hi"))
    return telemetry.join(skew.small(limits), "metric_name", "left").select(
        *telemetry.columns, fr.quality_flag(F.col("metric_value"), F.col("_lo"), F.col("_hi")).alias("quality_flag"))


def clean_readings(readings: DataFrame, include_faults: bool = False) -> DataFrame:
    """PF9: the guard on every telemetry read. It runs before a join, so an
    outer join keeps its unmatched rows."""
    return readings if include_faults else readings.where(F.col("quality_flag").isNull())


def changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """PF10/PF6: metrics whose limits differ, appeared or went away."""
    o = old.select("metric_name", F.struct("min_value", "max_value").alias("_old"))
    n = new.select("metric_name", F.struct("min_value", "max_value").alias("_new"))
    return o.join(n, "metric_name", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))).select("metric_name")


def reflag(readings: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """PF10: recomputes flags of changed metrics only; others pass untouched."""
    changed = skew.small(changed_ranges(old, new))
    again = flag_readings(readings.drop("quality_flag").join(changed, "metric_name", "left_semi"), new)
    return readings.join(changed, "metric_name", "left_anti").unionByName(again)


def with_warnings(telemetry: DataFrame, ranges: DataFrame) -> DataFrame:
    """PF11: adds the sentence that explains an impossible reading."""
    limits = ranges.select("metric_name", "unit", F.col("min_value").alias("_lo"), F.col("max_value").alias("_hi"))
    warning = fr.physical_warning(F.col("metric_name"), F.col("metric_value"), F.col("unit"), F.col("_lo"), F.col("_hi"))
    return telemetry.join(skew.small(limits), "metric_name", "left").select(
        *telemetry.columns, warning.alias("quality_warning"))


def rule_audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """PF13: rows that break each rule, all rules in one scan. A rule that is
    NULL for a row holds, as a CHECK constraint does."""
    broken = df.agg(*[F.count(F.when(~rule, 1)).alias(name) for name, rule in rules.items()])
    return broken.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def orphan_audit(pairs: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows of a child table whose key has no parent, per declared pair
    (name, child, child key, parent, parent key). The child is counted per key
    before the join, so a key with many rows costs one."""
    def one(name, child, ck, parent, pk):
        keys = child.where(F.col(ck).isNotNull()).groupBy(F.col(ck).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        lost = keys.join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
        return lost.agg(F.lit(name).alias("pair"), F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans"))

    return reduce(DataFrame.unionByName, [one(*p) for p in pairs])
