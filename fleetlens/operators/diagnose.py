"""Readings against the baselines of their model and mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import readings as fr
from fleetlens.operators import skew

BASELINE_KEYS = ["model_code", "drive_mode", "metric_name"]


def with_baseline(clean: DataFrame, vehicles: DataFrame, baselines: DataFrame, how: str = "inner") -> DataFrame:
    """Each reading with the baseline of its vehicle's model, mode and
    metric. `how='left'` keeps readings that have none. A baseline table that a
    count shows to be small goes to every task; for vehicles Spark picks the
    join from their size."""
    models = vehicles.select("vehicle_id", "model_code")
    return clean.join(models, "vehicle_id").join(skew.small(baselines), BASELINE_KEYS, how)


def _partial(clean: DataFrame) -> DataFrame:
    """Sums per vehicle, metric and mode: all that a mean needs, as the baseline depends on nothing else of a reading.
    The joins that follow see these rows instead of the readings."""
    return clean.groupBy("vehicle_id", "metric_name", "drive_mode").agg(
        *_unit(clean), F.sum("metric_value").alias("_sum"), F.count("metric_value").alias("_n"), F.count(F.lit(1)).alias("_rows"))


def _unit(df: DataFrame) -> list:
    """Readings that name their unit keep it."""
    return [F.max("unit").alias("unit")] if "unit" in df.columns else []


def _mean(where=None):
    """Mean reading and mean baseline over the rows of `_partial` that `where` takes."""
    def only(c):
        return c if where is None else F.when(where, c)

    known = F.when(F.col("nominal_value").isNotNull(), F.col("_rows"))
    return (F.try_divide(F.sum(only(F.col("_sum"))), F.sum(only(F.col("_n")))),
            F.try_divide(F.sum(only(F.col("nominal_value") * F.col("_rows"))), F.sum(only(known))))


def compare(clean: DataFrame, vehicles: DataFrame, baselines: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """AG11 + SF20: mean reading against the mean baseline, weighted by the mix
    of readings, with deviation and verdict. The largest tolerance counts."""
    actual, baseline = _mean()
    parts = with_baseline(_partial(clean), vehicles, baselines, how)
    means = parts.groupBy(*keys).agg(
        *_unit(clean), actual.alias("actual"), baseline.alias("baseline"), F.max("tolerance_pct").alias("tolerance_pct"), F.sum("_rows").alias("readings"))
    return judge(means)


def judge(means: DataFrame) -> DataFrame:
    a, b, t = F.col("actual"), F.col("baseline"), F.col("tolerance_pct")
    return means.withColumn("delta_pct", fr.delta_pct(a, b)).withColumn("verdict", fr.verdict(a, b, t))


def latest(df: DataFrame, keys: list[str], value: str, at: str, tie: str) -> DataFrame:
    """The newest value per key, an aggregate that combines before the shuffle."""
    return df.groupBy(*keys).agg(
        F.max_by(value, F.struct(at, tie)).alias(f"latest_{value}"), F.max(at).alias(f"latest_{at}"))


def since_onset(clean: DataFrame, vehicles: DataFrame, baselines: DataFrame, onsets: DataFrame, health: str) -> DataFrame:
    """AG12: per vehicle and metric since the vehicle's own onset (vehicle_id, onset), beside the latest
    reading of the metric `health`."""
    recent = clean.join(onsets, "vehicle_id").where(F.col("recorded_at") >= F.col("onset"))
    actual, baseline = _mean()
    means = with_baseline(_partial(recent), vehicles, baselines, "left").groupBy("vehicle_id", "metric_name").agg(
        actual.alias("actual"), baseline.alias("baseline"))
    last = recent.where(F.col("metric_name") == health).groupBy("vehicle_id").agg(
        F.max_by("metric_value", F.struct("recorded_at", "id")).alias("latest_health"))
    return means.withColumn("delta_pct", fr.delta_pct(F.col("actual"), F.col("baseline"))).join(last, "vehicle_id", "left")


def decline(clean: DataFrame, keys: list[str]) -> DataFrame:
    """Change per day by least squares, and the days watched."""
    day = F.unix_micros("recorded_at") / 86_400_000_000
    return clean.groupBy(*keys).agg(
        F.regr_slope(F.col("metric_value"), day).alias("per_day"), (F.max(day) - F.min(day)).alias("days"),
        F.count(F.lit(1)).alias("readings"))


def fleet_report(clean: DataFrame, vehicles: DataFrame, baselines: DataFrame, draw: str, speed: str, charge: str,
                 load: str, health: str) -> DataFrame:
    """DP39/AG5: one row per vehicle: means of each metric against its baseline with a verdict, loads above the rating, health
    first and last, and a rule-based scenario. The metric names are parameters. Readings are summed
    per vehicle, metric and mode before they meet vehicles and baselines."""
    metrics = clean.groupBy("vehicle_id", "metric_name", "drive_mode").agg(
        F.sum("metric_value").alias("_sum"), F.count("metric_value").alias("_n"), F.count(F.lit(1)).alias("_rows"),
        F.max_by("metric_value", F.struct("recorded_at", "id")).alias("_last"), F.max(F.struct("recorded_at", "id")).alias("_last_at"),
        F.min_by("metric_value", F.struct("recorded_at", "id")).alias("_first"), F.min(F.struct("recorded_at", "id")).alias("_first_at"))
    m, aggregates = F.col("metric_name"), []
    for name in (draw, speed, charge):
        actual, baseline = _mean(m == name)
        aggregates += [actual.alias(f"{name}_actual"), baseline.alias(f"{name}_baseline"), F.max(F.when(m == name, F.col("tolerance_pct"))).alias(f"{name}_tolerance")]
    wide = with_baseline(metrics, vehicles, baselines, "left").groupBy("vehicle_id", "model_code").agg(
        *aggregates, F.max_by("_last", F.when(m == health, F.col("_last_at"))).alias("health_last"),
        F.min_by("_first", F.when(m == health, F.col("_first_at"))).alias("health_first"))
    # Only loads are compared with a rating row by row.
    above = with_baseline(clean.where(m == load), vehicles, baselines).where("metric_value > rated_payload").groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("overloads"))
    wide = wide.join(above, "vehicle_id", "left").withColumn("overloads", F.coalesce("overloads", F.lit(0)))
    for name in (draw, speed, charge):
        a, b, t = (F.col(f"{name}_{c}") for c in ("actual", "baseline", "tolerance"))
        wide = wide.withColumn(f"{name}_delta", fr.delta_pct(a, b)).withColumn(f"{name}_verdict", fr.verdict(a, b, t))
    scenario = (
        F.when((F.col(f"{draw}_delta") > 15) & (F.col("overloads") > 0), "overload")
        .when(F.col("health_last") < F.col("health_first") - 5, "cell_wear")
        .when(F.col(f"{speed}_delta") < -15, "speed_cap")
        .when(F.col(f"{charge}_delta") < -30, "charger_fault")
        .when(F.col(f"{draw}_delta") > 15, "unexplained")
        .otherwise("normal"))
    return wide.withColumn("scenario", scenario)
