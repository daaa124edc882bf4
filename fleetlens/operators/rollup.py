"""Hourly rollups and what is derived from them."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions import timefn
from fleetlens.operators import skew

KEYS = ["hour", "vehicle_id", "metric_name", "drive_mode"]


def measures(readings: DataFrame):
    """The partial aggregates of the rollup, for batch and stream alike. Readings that name their unit keep it."""
    v = F.col("metric_value")
    return [*_unit(readings), F.count(F.lit(1)).alias("readings"), F.sum(v).alias("sum_value"), F.avg(v).alias("avg_value"),
            F.min(v).alias("min_value"), F.max(v).alias("max_value")]


def _unit(df: DataFrame) -> list[Column]:
    return [F.max("unit").alias("unit")] if "unit" in df.columns else []


def hourly(clean: DataFrame) -> DataFrame:
    """AG7: partial sums meet before the shuffle, so a busy vehicle costs one
    row per hour and task. NULL mode is a group."""
    return clean.groupBy(
        F.date_trunc("hour", "recorded_at").alias("hour"), "vehicle_id", "metric_name", "drive_mode").agg(*measures(clean))


def rebucket(rollup: DataFrame, seconds: int, keys: list[str]) -> DataFrame:
    """AG8/AG9: wider buckets from rollup rows. The mean comes from the sums and
    counts, never from the hourly means."""
    return rollup.groupBy(timefn.time_bucket(seconds, F.col("hour")).alias("bucket"), *keys).agg(
        *_unit(rollup), F.sum("readings").alias("readings"), F.sum("sum_value").alias("sum_value"),
        (F.sum("sum_value") / F.sum("readings")).alias("avg_value"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def trend(buckets: DataFrame, keys: list[str], value: str = "avg_value") -> DataFrame:
    """Change against the bucket before. One row per key and bucket, so a
    window per key holds no more rows than there are buckets."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    before = F.lag(value).over(w)
    return buckets.select("*", before.alias("previous_value")).withColumn(
        "change_pct",
        F.when(F.col("previous_value") != 0,
               (F.col(value) - F.col("previous_value")) / F.abs("previous_value") * 100))


def realtime(materialised: DataFrame, clean: DataFrame, high_water: str) -> DataFrame:
    """ST4: stored hours before the mark, hours from it on computed now."""
    mark = F.to_timestamp(F.lit(high_water))
    live = hourly(clean.where(F.col("recorded_at") >= mark))
    return materialised.where(F.col("hour") < mark).unionByName(live)


def _within(starts: list, unit: str = "hour", column: str = "recorded_at") -> Column:
    """Whether a time is in one of the hours (or days); those in a row are one range, which the scan can skip files by."""
    spans: list[list] = []
    for start in sorted(starts):
        end = start + dt.timedelta(**{f"{unit}s": 1})
        if spans and start == spans[-1][1]:
            spans[-1][1] = end
        else:
            spans.append([start, end])
    return functools.reduce(lambda x, y: x | y, [(F.col(column) >= F.lit(a)) & (F.col(column) < F.lit(b)) for a, b in spans])


def touched_hours(arrived: DataFrame, unit: str = "hour") -> list:
    """The hours (or days) of some readings: at most as many as history has."""
    return [r[0] for r in arrived.where(F.col("recorded_at").isNotNull()).select(F.date_trunc(unit, "recorded_at").alias("h")).distinct().collect()]


def refresh_touched(materialised: DataFrame, clean: DataFrame, arrived: DataFrame) -> DataFrame:
    """ST5: recomputes the hours that late rows touched, whatever their age.
    The touched keys are distinct (hour, vehicle, metric, mode) rows. Only readings of the touched hours are scanned."""
    hours = touched_hours(arrived)
    if not hours:
        return materialised
    touched = arrived.select(F.date_trunc("hour", "recorded_at").alias("hour"), *KEYS[1:]).distinct()
    keep = _semi(materialised, touched, "left_anti")
    source = clean.where(_within(hours)).withColumn("hour", F.date_trunc("hour", "recorded_at"))
    return keep.unionByName(hourly(_semi(source, touched, "left_semi").drop("hour")))


def store(rollup: DataFrame, path: str, unit: str = "day") -> None:
    """The rollup as a stored table with a folder for each day (or hour, where an hour fills a file). Those that have a
    folder already are replaced, others stay."""
    parts = rollup.withColumn("part", F.date_format(F.date_trunc(unit, "hour"), "yyyyMMddHH"))
    parts.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def refresh_stored(clean: DataFrame, arrived: DataFrame, path: str, unit: str = "day") -> int:
    """ST5 on a stored rollup: the days (or hours) that late rows touched are computed from all their readings and written anew; no
    other file is read or written, and running it again changes nothing. Returns how many were touched."""
    touched = touched_hours(arrived, unit)
    if touched:
        store(hourly(clean.where(_within(touched, unit))), path, unit)
    return len(touched)


def _semi(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    k = keys.select(*[F.col(c).alias(f"_{c}") for c in KEYS])
    on = (F.col("hour") == F.col("_hour")) & (F.col("vehicle_id") == F.col("_vehicle_id")) & (
        F.col("metric_name") == F.col("_metric_name")) & F.col("drive_mode").eqNullSafe(F.col("_drive_mode"))
    return df.join(k, on, how)


def compact(readings: DataFrame, path: str, rows_per_file: int = 4_000_000) -> None:
    """ST16: one folder per 7-day bucket, rows ordered by vehicle, metric and
    time so that row groups can be skipped. A week gets files in proportion to its rows; the hash of vehicle and metric plus
    the time inside the week spreads a busy week or vehicle over its files."""
    out = readings.withColumn("week", F.to_date(timefn.time_bucket(7 * 86400, F.col("recorded_at"))))
    files = out.groupBy("week").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("long").alias("_files"))
    out = out.join(skew.small(files), "week").withColumn(
        "_part", F.pmod(F.xxhash64("vehicle_id", "metric_name", F.date_trunc("hour", "recorded_at")), F.col("_files")))
    (out.repartition("week", "_part").drop("_part", "_files")
        .sortWithinPartitions("week", "vehicle_id", "metric_name", F.desc("recorded_at"))
        .write.mode("overwrite").partitionBy("week").parquet(path))
