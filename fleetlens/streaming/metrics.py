"""Windowed service metrics and live sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import feedback, opsmetrics


def sliding_ratio(events: DataFrame, at: str, part: Column, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    """ST10: the share of `part` in each sliding window."""
    return events.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("_w")).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(part, 1)).alias("part")).select(
        F.col("_w.start").alias("start"), "total", "part", opsmetrics.ratio(F.col("part"), F.col("total")).alias("ratio"))


def histograms(events: DataFrame, at: str, value: str, bounds: list[float], width: str, slide: str | None = None,
               late: str = "1 hour") -> DataFrame:
    """ST11: one row per window with the cumulative bucket counts as an array."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    names = [f"_b{i}" for i in range(len(bounds) + 1)]
    counts = [c.alias(n) for c, n in zip(opsmetrics.bucket_counts(F.col(value), bounds), names)]
    return events.withWatermark(at, late).groupBy(window.alias("_w")).agg(*counts).select(
        F.col("_w.start").alias("start"), F.array(*names).alias("buckets"))


def bucket_rows(windows: DataFrame, bounds: list[float]) -> DataFrame:
    """Histogram windows as (start, le, count) rows."""
    limits = [*bounds, float("inf")]
    return windows.select("start", F.inline(F.array(*[
        F.struct(F.lit(le).alias("le"), F.col("buckets")[i].alias("count")) for i, le in enumerate(limits)])))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """ST15: activity sessions that end after a gap."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("events")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")


def live_reviews(turns: DataFrame, scores: DataFrame, dimensions: list[str], rate: float = 0.1, flag_at: int = 2) -> DataFrame:
    """ST14: eligible turns drawn by the hash of their id, with their scores;
    `flagged` sends the low ones to the review queue. turns: turn_id, answer,
    partial, evidence_count."""
    drawn = turns.where(feedback.eligible()).where(opsmetrics.hash_share(F.col("turn_id").cast("string")) < rate)
    return drawn.join(scores, "turn_id").withColumn("flagged", F.least(*dimensions) <= flag_at)
