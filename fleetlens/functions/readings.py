"""Column expressions over sensor readings."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fleetlens import reference as ref


def quality_flag(value, lo, hi) -> Column:
    """UD1/PF8: why a reading is impossible, NULL when it is plausible or
    its metric has no limits. Bounds are inclusive."""
    return F.when(value < lo, F.lit("below_physical_range")).when(value > hi, F.lit("above_physical_range"))


def register_quality_flag(spark: SparkSession) -> None:
    """UD1 for SQL users: telemetry_quality_flag(value, lo, hi)."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION telemetry_quality_flag(v DOUBLE, lo DOUBLE, hi DOUBLE)
           RETURNS STRING RETURN CASE WHEN v < lo THEN 'below_physical_range'
                                      WHEN v > hi THEN 'above_physical_range' END"""
    )


def plain_number(value) -> Column:
    """Six significant digits without trailing zeros: 45.20 -> 45.2, 250.0 -> 250."""
    shown = F.format_string("%.6g", value)
    return F.when(value == 0, F.lit("0")).otherwise(
        F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    )


def physical_warning(metric, value, unit, lo, hi) -> Column:
    """PF11: the sentence shown with an impossible reading, else NULL."""
    text = F.concat(
        metric, F.lit(" "), plain_number(value), F.lit(" is outside its physical range "),
        plain_number(lo), F.lit(" to "), plain_number(hi),
        F.when(F.length(unit) > 0, F.concat(F.lit(" "), unit)).otherwise(F.lit("")),
        F.lit(": a sensor fault, not a measurement"),
    )
    return F.when((value < lo) | (value > hi), text)


def finite(value) -> Column:
    """PF16: the value as a double, NULL when it is not a finite number."""
    d = value.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def first_present(df, names) -> Column:
    """PF15: the first non-null of the columns in `names` that exist, any case."""
    have = {c.lower(): c for c in df.columns}
    present = [F.col(have[n]) for n in names if n in have]
    return F.coalesce(*present) if present else F.lit(None)


def delta_pct(actual, baseline) -> Column:
    """SF20: deviation in percent of the baseline, one decimal. Rounded to nine digits first: means of doubles differ in
    their last digits with the order of the sum, which must not decide a tie."""
    return F.when(baseline != 0, F.round(F.round((actual - baseline) / F.abs(baseline) * 100, 9), 1))


def tolerance(pct) -> Column:
    """A tolerance of NULL or 0 means the default."""
    return F.coalesce(F.nullif(pct, F.lit(0.0)), F.lit(ref.DEFAULT_TOLERANCE_PCT))


def verdict(actual, baseline, tolerance_pct) -> Column:
    """SF20: the label of a comparison; the rounded deviation decides."""
    delta = delta_pct(actual, baseline)
    return (
        F.when(baseline.isNull(), "no_baseline")
        .when(baseline == 0, "not_applicable")
        .when(F.abs(delta) <= tolerance(tolerance_pct), "normal")
        .when(delta > 0, "above_normal")
        .otherwise("below_normal")
    )
