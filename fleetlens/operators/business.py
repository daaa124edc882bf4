"""Sales by region, channel, model and calendar period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import timefn
from fleetlens.operators import skew


def calendar(spark: SparkSession, as_of: str, **settings) -> DataFrame:
    """SF7: eight rows (period, lo, hi), both days inclusive."""
    return spark.range(1).select(F.inline(timefn.periods(F.lit(as_of), **settings)))


def by_period(sales: DataFrame, periods: DataFrame, dims: list[str]) -> DataFrame:
    """Units and revenue per calendar period; a sale counts in every period
    that holds its day. Sales are summed per day first, so the range join sees
    one row per day and group."""
    daily = sales.groupBy("sold_on", *dims).agg(F.count(F.lit(1)).alias("units"), F.sum("unit_price").alias("revenue"))
    joined = daily.join(skew.small(periods, 1000), (F.col("sold_on") >= F.col("lo")) & (F.col("sold_on") <= F.col("hi")))
    return joined.groupBy("period", *dims).agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))


def shares(sales: DataFrame, dim: str) -> DataFrame:
    """AG36: units of each group and their share of all units."""
    groups = sales.groupBy(dim).agg(F.count(F.lit(1)).alias("units"))
    return groups.withColumn("share_pct", F.round(100 * F.col("units") / groups.agg(F.sum("units")).scalar(), 2))


def compare_periods(sales: DataFrame, dim: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """AG36: units per group in two spans of days and the change between them."""
    day = F.col("sold_on")
    both = sales.where(day.between(*first) | day.between(*second)).groupBy(dim).agg(
        F.count(F.when(day.between(*first), 1)).alias("units_before"),
        F.count(F.when(day.between(*second), 1)).alias("units_after"))
    change = F.when(F.col("units_before") != 0, F.round(
        100 * (F.col("units_after") - F.col("units_before")) / F.col("units_before"), 1))
    return both.withColumn("change_pct", change)
