"""Service metrics: counters, histograms, quantiles, ratios, cost, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens.operators import skew


def hash_share(key: Column) -> Column:
    """TK8: a number in 0..1 that depends on the key alone."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def bucket_counts(value: Column, bounds: list[float]) -> list[Column]:
    """AG31: one aggregate per bound, cumulative, and the total for +Inf."""
    return [F.count(F.when(value <= b, 1)) for b in bounds] + [F.count(value)]


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """AG31: rows (keys, le, count), cumulative; +Inf is the last bound. One
    pass: the bounds are columns of a single aggregate, then rows."""
    counts = bucket_counts(F.col(value), bounds)
    wide = df.groupBy(*keys).agg(*[c.alias(f"_b{i}") for i, c in enumerate(counts)])
    limits = [*bounds, float("inf")]
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(le).alias("le"), F.col(f"_b{i}").alias("count")) for i, le in enumerate(limits)])))


def histogram_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """AG32: quantile from cumulative buckets, linear inside a bucket; when it
    falls beyond the last bound, that bound. A window holds one row per bucket."""
    w = Window.partitionBy(*keys).orderBy("le")
    total = F.max("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = hist.select(
        *keys, "le", "count", F.lag("count", 1, 0).over(w).alias("_below"), F.lag("le", 1, 0.0).over(w).alias("_from"),
        (total * q).alias("_rank"))
    inside = F.col("_from") + (F.col("le") - F.col("_from")) * F.try_divide(
        F.col("_rank") - F.col("_below"), F.col("count") - F.col("_below"))
    at = F.when(F.col("le") == float("inf"), F.col("_from")).otherwise(inside)
    hit = rows.where(F.col("count") >= F.col("_rank"))
    return hit.groupBy(*keys).agg(F.min_by(at, "le").alias("quantile"))


def ratio(part: Column, whole: Column) -> Column:
    """AG33: a ratio whose denominator never is zero."""
    return part / F.greatest(whole.cast("double"), F.lit(1e-9))


def prices(spark: SparkSession) -> DataFrame:
    rows = [(m, i, o) for m, (i, o) in ref.PRICES.items()]
    return spark.createDataFrame(rows, "model string, input_price double, output_price double")


def call_costs(calls: DataFrame, price_list: DataFrame, keys: list[str]) -> DataFrame:
    """AG34: tokens and cost per group; a model without a price costs nothing."""
    cost = (F.col("input") * F.coalesce("input_price", F.lit(0.0))
            + F.col("output") * F.coalesce("output_price", F.lit(0.0))) / 1e6
    return calls.join(skew.small(price_list), "model", "left").groupBy(*keys).agg(
        F.sum("input").alias("input"), F.sum("output").alias("output"), F.round(F.sum(cost), 6).alias("cost_usd"))


def rolling_sum(df: DataFrame, keys: list[str], at: str, value: str, seconds: int = 60, span: int = 3600) -> DataFrame:
    """Sum over the last `seconds`, the row's own second included. Time is
    cut into spans; rows near the end of a span are repeated in the next one, so
    a busy key spreads over as many tasks as it has spans."""
    sec = F.floor(F.unix_micros(at) / 1_000_000)
    here = F.floor(sec / span)
    later = F.floor((sec + seconds - 1) / span)
    copies = df.withColumn("_sec", sec).withColumn("_home", here).withColumn("_span", F.explode(F.sequence(here, later)))
    w = Window.partitionBy(*keys, "_span").orderBy("_sec").rangeBetween(-(seconds - 1), 0)
    out = copies.withColumn("used", F.sum(value).over(w)).where(F.col("_span") == F.col("_home"))
    return out.drop("_sec", "_home", "_span")


def streaks(df: DataFrame, keys: list[str], order: Column, tie: list[str], bad: Column, at_least: int,
            at: str, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Runs of consecutive bad rows of at least `at_least`, with their span.
    A run is named by the good rows before it, a running sum; the runs are then
    plain groups."""
    good = F.when(bad, 0).otherwise(1)
    rows = skew.running(df, keys, order, tie, {"_goods": good}, hot_rows).where(bad)
    runs = rows.groupBy(*keys, "_goods").agg(
        F.count(F.lit(1)).alias("length"), F.min(at).alias("started"), F.max(at).alias("ended"))
    return runs.where(F.col("length") >= at_least).drop("_goods")


def held_alerts(windows: DataFrame, keys: list[str], start: str, firing: Column, hold_s: int, step_s: int) -> DataFrame:
    """ST12: spans in which a condition held for at least `hold_s` seconds over
    consecutive windows `step_s` apart. One row per window goes in, so a key
    has as many rows as windows."""
    pos = F.floor(F.unix_micros(start) / (1_000_000 * step_s))
    lit = windows.where(firing).withColumn("_pos", pos)
    w = Window.partitionBy(*keys).orderBy("_pos")
    island = lit.withColumn("_island", F.col("_pos") - F.row_number().over(w))
    spans = island.groupBy(*keys, "_island").agg(F.min(start).alias("pending_since"), F.max(start).alias("last_seen"))
    held = (F.unix_micros("last_seen") - F.unix_micros("pending_since")) / 1_000_000
    return spans.withColumn("held_s", held).where(F.col("held_s") >= hold_s).drop("_island")
