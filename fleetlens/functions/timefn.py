"""Time buckets and the working calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_ORIGIN = "2000-01-03 00:00:00"
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def time_bucket(seconds: int, ts, origin: str = WEEK_ORIGIN) -> Column:
    """SF6: start of the fixed-width bucket holding `ts`, aligned to `origin`."""
    width = F.lit(seconds * 1_000_000)
    us = F.unix_micros(ts)
    start = F.unix_micros(F.to_timestamp(F.lit(origin)))
    return F.timestamp_micros(us - F.pmod(us - start, width))


def month_start(day, months_back=0) -> Column:
    return F.add_months(F.trunc(day, "month"), -months_back if isinstance(months_back, int) else -1 * months_back)


def periods(day, week_mode: str = "rolling_7_days", week_starts_on: str = "monday",
            year_start_month: int = 1) -> Column:
    """SF7: array of (period, lo, hi) for a date; both bounds inclusive."""
    day = F.to_date(day)
    if week_mode == "rolling_7_days":
        this_week = (F.date_sub(day, 6), day)
        last_week = (F.date_sub(day, 13), F.date_sub(day, 7))
    else:
        start = F.date_sub(day, F.pmod(F.weekday(day) - WEEKDAYS.index(week_starts_on), F.lit(7)).cast("int"))
        this_week = (start, day)
        last_week = (F.date_sub(start, 7), F.date_sub(start, 1))
    into_year = F.pmod(F.month(day) - year_start_month, F.lit(12)).cast("int")
    quarter = month_start(day, into_year % 3)
    rows = [
        ("today", day, day),
        ("this week", *this_week),
        ("last week", *last_week),
        ("this month", month_start(day), day),
        ("last month", month_start(day, 1), F.date_sub(month_start(day), 1)),
        ("this quarter", quarter, day),
        ("last quarter", F.add_months(quarter, -3), F.date_sub(quarter, 1)),
        ("this year", month_start(day, into_year), day),
    ]
    return F.array(*[F.struct(F.lit(n).alias("period"), lo.alias("lo"), hi.alias("hi")) for n, lo, hi in rows])


def quarter_label(day, year_start_month: int = 1) -> Column:
    """SF8: 'Q3 2026', or 'Q4 FY2025' when the year starts in another month."""
    into_year = F.pmod(F.month(day) - year_start_month, F.lit(12)).cast("int")
    quarter = (F.floor(into_year / 3) + 1).cast("string")
    year = F.when(F.month(day) >= year_start_month, F.year(day)).otherwise(F.year(day) - 1).cast("string")
    sep = " " if year_start_month == 1 else " FY"
    return F.concat(F.lit("Q"), quarter, F.lit(sep), year)


def in_zone(ts, lo, hi, zone: str) -> Column:
    """PF3: `ts` (UTC) lies on the days lo..hi of `zone`: at or after the first
    midnight and before the midnight that follows the last day."""
    start = F.to_utc_timestamp(F.to_timestamp(lo), zone)
    end = F.to_utc_timestamp(F.to_timestamp(F.date_add(hi, 1)), zone)
    return (ts >= start) & (ts < end)
