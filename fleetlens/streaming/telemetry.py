"""Readings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import quality, rollup
from fleetlens.streaming import runner

LATE = "3 days"
EVERY = "30 minutes"


def flagged(readings: DataFrame, ranges: DataFrame) -> DataFrame:
    """ST1: each reading flagged on arrival, a join of the stream with the limits."""
    return quality.flag_readings(readings, ranges)


def hourly(readings: DataFrame, late: str = LATE) -> DataFrame:
    """ST2: the hourly rollup as a stream. An hour is kept open for `late`; its
    partial sums are the state."""
    return (
        readings.withWatermark("recorded_at", late)
        .groupBy(F.window("recorded_at", "1 hour").alias("_w"), "vehicle_id", "metric_name", "drive_mode")
        .agg(*rollup.measures(readings))
        .select(F.col("_w.start").alias("hour"), "vehicle_id", "metric_name", "drive_mode",
                *(["unit"] if "unit" in readings.columns else []), "readings", "sum_value", "avg_value", "min_value", "max_value"))


def start_rollup(readings: DataFrame, path: str, every: str = EVERY):
    """ST3: refreshes the stored rollup every 30 minutes; rows up to three days
    late still change their hour."""
    return runner.start(hourly(readings), runner.to_folder(path), "rollup", "update", every)


def current_rollup(rows: DataFrame) -> DataFrame:
    """The stored rollup: the newest row of each hour and key."""
    return runner.newest(rows, rollup.KEYS)
