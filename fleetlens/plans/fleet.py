"""Telemetry: quality, rollups, baselines, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions import readings as fr
from fleetlens.functions import timefn
from fleetlens.operators import diagnose, quality, rollup, skew
from fleetlens.plans.bindings import METRICS, MODES, RANGES, TELEMETRY_AS_OF
from fleetlens.plans.registry import query
from fleetlens.sources import tables as src

WEEK_AGO = src.days_before(TELEMETRY_AS_OF, 7)
MICROS = "recorded_at"


def us(column):
    return F.unix_micros(column)


@query("dp00_vehicle_vs_baseline", """
    SELECT vehicle_id, metric_name, round(actual, 6) AS actual, round(baseline, 6) AS baseline, tolerance_pct, readings,
           delta_pct, CASE WHEN baseline IS NULL THEN 'no_baseline' WHEN baseline = 0 THEN 'not_applicable'
               WHEN abs(delta_pct) <= coalesce(nullif(tolerance_pct, 0), 10) THEN 'normal'
               WHEN delta_pct > 0 THEN 'above_normal' ELSE 'below_normal' END AS verdict
    FROM (SELECT *, round(round((actual - baseline) / abs(baseline) * 100, 9), 1) + 0.0 AS delta_pct
          FROM (SELECT c.vehicle_id, c.metric_name, avg(metric_value) AS actual, avg(nominal_value) AS baseline,
                       max(tolerance_pct) AS tolerance_pct, count(*) AS readings
                FROM clean c JOIN vehicles v ON v.vehicle_id = c.vehicle_id
                JOIN baselines b ON b.model_code = v.model_code AND b.drive_mode = c.drive_mode AND b.metric_name = c.metric_name
                WHERE recorded_at >= TIMESTAMP '2024-01-24' GROUP BY ALL))""")
def vehicle_vs_baseline(t):
    """Last seven days of every vehicle against its baselines (J2, PF2, PF9, AG11, SF20)."""
    week = quality.clean_readings(quality.flag_readings(t.telemetry_since(WEEK_AGO), t.ranges))
    out = diagnose.compare(week, t.vehicles, t.baselines, ["vehicle_id", "metric_name"])
    return out.withColumn("actual", F.round("actual", 6)).withColumn("baseline", F.round("baseline", 6))


@query("io01_table_scan", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def table_scan(t):
    t.nation.createOrReplaceTempView("fl_nation")
    t.region.createOrReplaceTempView("fl_region")
    return t.spark.sql("SELECT n_nationkey, n_name, r_name FROM fl_nation JOIN fl_region ON r_regionkey = n_regionkey")


@query("io14_reference_rows", """
    SELECT r.metric_name, min_value, max_value, count(id) AS readings FROM ranges r LEFT JOIN telemetry t
    ON t.metric_name = r.metric_name GROUP BY ALL""")
def reference_rows(t):
    counts = t.telemetry.groupBy("metric_name").agg(F.count("id").alias("readings"))
    return t.ranges.join(counts, "metric_name", "left").withColumn("readings", F.coalesce("readings", F.lit(0)))


@query("pf01_filters", """
    SELECT id, vehicle_id, sold_on, region, channel, unit_price FROM sales
    WHERE region IN ('ASIA', 'EUROPE') AND channel = '1-URGENT' AND sold_on BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'
      AND unit_price > 100000""")
def filters(t):
    picked = (t.sales.where(F.col("region").isin("ASIA", "EUROPE")).where("channel = '1-URGENT'")
              .where(F.col("sold_on").between("1998-01-01", "1998-12-31")).where("unit_price > 100000"))
    return picked.select("id", "vehicle_id", "sold_on", "region", "channel", "unit_price")


@query("pf02_last_week", """
    SELECT vehicle_id, count(*) AS readings, max(metric_value) AS top FROM telemetry
    WHERE recorded_at >= TIMESTAMP '2024-01-24' GROUP BY vehicle_id""")
def last_week(t):
    """PF2/PF14/PF17: seven days before the pinned day; the bound reaches the scan."""
    return t.telemetry_since(WEEK_AGO).groupBy("vehicle_id").agg(
        F.count("*").alias("readings"), F.max("metric_value").alias("top"))


@query("pf08_quality_flags", "SELECT id, metric_name, metric_value, quality_flag FROM readings")
def quality_flags(t):
    return t.readings.select("id", "metric_name", "metric_value", "quality_flag")


@query("ud01_quality_flag_sql", "SELECT quality_flag, count(*) AS readings FROM readings GROUP BY quality_flag")
def quality_flag_sql(t):
    """The flag as a SQL function for SQL users."""
    fr.register_quality_flag(t.spark)
    rows = t.telemetry.join(t.ranges, "metric_name", "left")
    flag = F.expr("telemetry_quality_flag(metric_value, min_value, max_value)")
    return rows.groupBy(flag.alias("quality_flag")).agg(F.count("*").alias("readings"))


@query("pf09_clean_guard", """
    SELECT v.vehicle_id, count(c.id) AS clean_readings FROM vehicles v LEFT JOIN readings c
    ON c.vehicle_id = v.vehicle_id AND c.quality_flag IS NULL GROUP BY v.vehicle_id""")
def clean_guard(t):
    """Every vehicle stays, also those without a clean reading: faults go before the outer join."""
    counts = t.clean.groupBy("vehicle_id").agg(F.count("id").alias("clean_readings"))
    return t.vehicles.select("vehicle_id").join(counts, "vehicle_id", "left").withColumn(
        "clean_readings", F.coalesce("clean_readings", F.lit(0)))


@query("pf10_reflag_changed", """
    SELECT t.id, CASE WHEN metric_value < n.lo THEN 'below_physical_range'
                      WHEN metric_value > n.hi THEN 'above_physical_range' END AS quality_flag
    FROM telemetry t LEFT JOIN (VALUES ('click', 0.5, 90.0), ('error', 1.0, 140.0), ('purchase', 0.5, 150.0), ('view', 0.5, 120.0))
      n(m, lo, hi) ON n.m = t.metric_name""")
def reflag_changed(t):
    """One limit moved, one went away, one is new; the rest keep their flags."""
    new = src.reference_rows(t.spark, "metric_name string, min_value double, max_value double", [
        ("click", 0.5, 90.0), ("error", 1.0, 140.0), ("purchase", 0.5, 150.0), ("view", 0.5, 120.0)])
    return quality.reflag(t.readings, t.ranges, new).select("id", "quality_flag")


@query("pf11_physical_warnings", """
    SELECT t.id, CASE WHEN metric_value < min_value OR metric_value > max_value THEN
        t.metric_name || ' ' || format('{:g}', metric_value) || ' is outside its physical range ' || format('{:g}', min_value) || ' to '
        || format('{:g}', max_value) || ' units: a sensor fault, not a measurement' END AS quality_warning
    FROM telemetry t LEFT JOIN ranges r ON r.metric_name = t.metric_name""")
def physical_warnings(t):
    return quality.with_warnings(t.telemetry, t.ranges.withColumn("unit", F.lit("units"))).select("id", "quality_warning")


@query("pf12_published_columns", "SELECT vec_id, label FROM embeddings")
def published_columns(t):
    return src.published(t.embeddings)


@query("pf13_rule_audit", """
    SELECT 'known_status' AS rule, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS violations FROM orders
    UNION ALL SELECT 'priced', count(*) FILTER (WHERE NOT o_totalprice >= 2000) FROM orders
    UNION ALL SELECT 'after_1995', count(*) FILTER (WHERE NOT o_orderdate >= TIMESTAMP '1995-02-01') FROM orders""")
def rule_audit(t):
    return quality.rule_audit(t.orders, {
        "known_status": F.col("o_orderstatus").isin("F", "O"), "priced": F.col("o_totalprice") >= 2000,
        "after_1995": F.col("o_orderdate") >= F.lit("1995-02-01").cast("timestamp_ntz")})


@query("pf15_first_present", """
    SELECT l_orderkey, l_linenumber, coalesce(nullif(l_tax, 0), nullif(l_discount, 0), l_quantity) AS actual FROM lineitem""")
def first_present(t):
    """Synonym columns: the first that exists and is not null wins, whatever its case."""
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("Actual_Value"),
        F.nullif("l_discount", F.lit(0.0)).alias("measured"), F.col("l_quantity").alias("AVG_ACTUAL"))
    from fleetlens import reference as ref
    return df.select("l_orderkey", "l_linenumber", fr.first_present(df, ref.ACTUAL_COLUMNS).alias("actual"))


@query("pf16_finite_numbers", """
    SELECT doc_id, try_cast(regexp_extract(text, '([0-9]+)', 1) AS DOUBLE) AS first_number,
           try_cast(source AS DOUBLE) AS source_number FROM documents""")
def finite_numbers(t):
    return t.documents.select(
        "doc_id", fr.finite(F.regexp_extract("text", "([0-9]+)", 1)).alias("first_number"),
        fr.finite(F.col("source")).alias("source_number"))


@query("pf17_bounded_read", """
    SELECT event_type AS metric_name, count(*) AS readings FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
def bounded_read(t):
    return t.telemetry_since("2024-01-10", "2024-01-20").groupBy("metric_name").agg(F.count("*").alias("readings"))


# joins

@query("j01_inner_join", """
    SELECT model_code, count(*) AS readings, round(avg(metric_value), 6) AS mean FROM telemetry t
    JOIN vehicles v ON v.vehicle_id = t.vehicle_id GROUP BY 1""")
def inner_join(t):
    return t.telemetry.join(t.vehicles, "vehicle_id").groupBy("model_code").agg(
        F.count("*").alias("readings"), F.round(F.avg("metric_value"), 6).alias("mean"))


@query("j03_left_baseline_join", """
    SELECT c.metric_name, c.drive_mode, count(*) AS readings, count(nominal_value) AS with_baseline,
           round(avg(metric_value), 6) AS actual, round(avg(nominal_value), 6) AS baseline
    FROM clean c JOIN vehicles v USING (vehicle_id)
    LEFT JOIN baselines b ON b.model_code = v.model_code AND b.drive_mode = c.drive_mode AND b.metric_name = c.metric_name
    GROUP BY 1, 2""")
def left_baseline_join(t):
    """Readings without a mode or a baseline survive."""
    return diagnose.with_baseline(t.clean, t.vehicles, t.baselines, "left").groupBy("metric_name", "drive_mode").agg(
        F.count("*").alias("readings"), F.count("nominal_value").alias("with_baseline"),
        F.round(F.avg("metric_value"), 6).alias("actual"), F.round(F.avg("nominal_value"), 6).alias("baseline"))


@query("j05_semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(t):
    big = t.orders.where("o_totalprice > 400000")
    return t.customer.join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j06_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(t):
    big = t.orders.where("o_totalprice > 400000")
    return t.customer.join(big, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("j09_range_join", """
    SELECT r.metric_name, count(*) AS outside FROM telemetry t JOIN ranges r
    ON r.metric_name = t.metric_name AND (t.metric_value < r.min_value OR t.metric_value > r.max_value) GROUP BY 1""")
def range_join(t):
    v = F.col("metric_value")
    return t.telemetry.join(t.ranges, "metric_name").where((v < F.col("min_value")) | (v > F.col("max_value"))).groupBy(
        "metric_name").agg(F.count("*").alias("outside"))


@query("j11_above_rating", """
    SELECT c.vehicle_id, count(*) AS above FROM clean c JOIN vehicles v ON v.vehicle_id = c.vehicle_id
    JOIN baselines b ON b.model_code = v.model_code AND b.drive_mode = c.drive_mode AND b.metric_name = c.metric_name
      AND c.metric_value > b.rated_payload GROUP BY 1""")
def above_rating(t):
    return diagnose.with_baseline(t.clean, t.vehicles, t.baselines).where("metric_value > rated_payload").groupBy(
        "vehicle_id").agg(F.count("*").alias("above"))


@query("j13_one_row_join", """
    WITH q AS (SELECT max(recorded_at) AS newest FROM telemetry)
    SELECT id, date_diff('second', recorded_at, newest) // 3600 AS hours_old FROM telemetry CROSS JOIN q""")
def one_row_join(t):
    """A one-row relation next to every row, as a scalar subquery."""
    newest = t.telemetry.agg(F.max("recorded_at")).scalar()
    seconds = F.unix_seconds(newest) - F.unix_seconds("recorded_at")
    return t.telemetry.select("id", F.floor(seconds / 3600).alias("hours_old"))


@query("j16_scalar_subquery", """
    SELECT id, metric_value FROM telemetry WHERE metric_value > 2 * (SELECT avg(metric_value) FROM telemetry)""")
def scalar_subquery(t):
    mean = t.telemetry.agg(F.avg("metric_value")).scalar()
    return t.telemetry.where(F.col("metric_value") > 2 * mean).select("id", "metric_value")


@query("j17_composed_queries", """
    WITH per AS (SELECT vehicle_id, count(*) AS n, avg(metric_value) AS mean FROM clean GROUP BY 1)
    SELECT region, sum(n)::BIGINT AS readings, round(max(mean), 6) AS top_mean
    FROM (SELECT * FROM per WHERE n > 3) x JOIN vehicles v ON v.vehicle_id = x.vehicle_id GROUP BY region""")
def composed_queries(t):
    per = t.clean.groupBy("vehicle_id").agg(F.count("*").alias("n"), F.avg("metric_value").alias("mean")).where("n > 3")
    return per.join(t.vehicles, "vehicle_id").groupBy("region").agg(
        F.sum("n").alias("readings"), F.round(F.max("mean"), 6).alias("top_mean"))


@query("j18_orphan_audit", """
    SELECT 'orders.customer' AS pair, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'labels.documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'customer.user', count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def orphan_audit(t):
    return quality.orphan_audit([
        ("orders.customer", t.orders, "o_custkey", t.customer, "c_custkey"),
        ("labels.documents", t.labels, "doc_id", t.documents, "doc_id"),
        ("customer.user", t.customer, "c_custkey", t.events, "user_id")])


# aggregates

@query("ag02_spread", """
    SELECT metric_name, round(stddev_samp(metric_value), 6) AS sd, round(var_samp(metric_value), 4) AS var FROM clean GROUP BY 1""")
def spread(t):
    return t.clean.groupBy("metric_name").agg(
        F.round(F.stddev_samp("metric_value"), 6).alias("sd"), F.round(F.var_samp("metric_value"), 4).alias("var"))


@query("ag03_percentiles", """
    SELECT metric_name, round(quantile_cont(metric_value, 0.5), 6) AS median, round(quantile_cont(metric_value, 0.95), 6) AS p95,
           quantile_disc(metric_value, 0.9) AS d90 FROM telemetry GROUP BY 1""")
def percentiles(t):
    out = skew.percentiles(t.telemetry, ["metric_name"], "metric_value", {
        "median": ("cont", 0.5), "p95": ("cont", 0.95), "d90": ("disc", 0.9)})
    return out.withColumn("median", F.round("median", 6)).withColumn("p95", F.round("p95", 6))


@query("ag04_bool_aggregates", """
    SELECT vehicle_id, bool_or(quality_flag IS NOT NULL) AS any_fault, bool_and(metric_value > 1) AS all_above FROM readings GROUP BY 1""")
def bool_aggregates(t):
    return t.readings.groupBy("vehicle_id").agg(
        F.bool_or(F.col("quality_flag").isNotNull()).alias("any_fault"), F.bool_and(F.col("metric_value") > 1).alias("all_above"))


@query("ag05_conditional_means", """
    SELECT vehicle_id, round(avg(metric_value) FILTER (WHERE metric_name = 'click'), 6) AS click,
           round(avg(metric_value) FILTER (WHERE metric_name = 'error'), 6) AS error,
           count(*) FILTER (WHERE metric_name = 'view' AND metric_value > 100) AS high_views FROM clean GROUP BY 1""")
def conditional_means(t):
    m, v = F.col("metric_name"), F.col("metric_value")
    return t.clean.groupBy("vehicle_id").agg(
        F.round(F.avg(F.when(m == "click", v)), 6).alias("click"), F.round(F.avg(F.when(m == "error", v)), 6).alias("error"),
        F.count(F.when((m == "view") & (v > 100), 1)).alias("high_views"))


@query("ag07_hourly_rollup", """
    SELECT date_trunc('hour', recorded_at) AS hour, vehicle_id, metric_name, drive_mode, count(*) AS readings,
           round(sum(metric_value), 4) AS sum_value, round(avg(metric_value), 6) AS avg_value,
           min(metric_value) AS min_value, max(metric_value) AS max_value FROM clean GROUP BY 1, 2, 3, 4""")
def hourly_rollup(t):
    return rollup.hourly(t.clean).withColumn("sum_value", F.round("sum_value", 4)).withColumn(
        "avg_value", F.round("avg_value", 6))


@query("ag08_mean_from_partials", """
    SELECT vehicle_id, metric_name, count(*) AS readings, round(avg(metric_value), 6) AS mean FROM clean GROUP BY 1, 2""")
def mean_from_partials(t):
    return rollup.hourly(t.clean).groupBy("vehicle_id", "metric_name").agg(
        F.sum("readings").alias("readings"), F.round(F.sum("sum_value") / F.sum("readings"), 6).alias("mean"))


@query("ag09_weekly_buckets", """
    SELECT time_bucket(INTERVAL '7 days', recorded_at) AS bucket, metric_name, count(*) AS readings,
           round(sum(metric_value), 4) AS sum_value, round(avg(metric_value), 6) AS avg_value,
           min(metric_value) AS min_value, max(metric_value) AS max_value FROM clean GROUP BY 1, 2""")
def weekly_buckets(t):
    return rollup.rebucket(rollup.hourly(t.clean), 7 * 86400, ["metric_name"]).withColumn(
        "sum_value", F.round("sum_value", 4)).withColumn("avg_value", F.round("avg_value", 6))


@query("ag11_comparison", """
    SELECT c.metric_name, round(avg(metric_value), 6) AS actual, round(avg(nominal_value), 6) AS baseline,
           max(tolerance_pct) AS tolerance_pct, count(*) AS readings
    FROM clean c JOIN vehicles v ON v.vehicle_id = c.vehicle_id
    JOIN baselines b ON b.model_code = v.model_code AND b.drive_mode = c.drive_mode AND b.metric_name = c.metric_name GROUP BY 1""")
def comparison(t):
    return diagnose.compare(t.clean, t.vehicles, t.baselines, ["metric_name"]).select(
        "metric_name", F.round("actual", 6).alias("actual"), F.round("baseline", 6).alias("baseline"), "tolerance_pct", "readings")


@query("ag12_since_onset", """
    WITH onsets AS (SELECT vehicle_id, min(recorded_at) AS onset FROM readings WHERE quality_flag IS NOT NULL GROUP BY 1),
    m AS (SELECT c.vehicle_id, c.metric_name, avg(metric_value) AS actual, avg(nominal_value) AS baseline
          FROM clean c JOIN onsets o ON o.vehicle_id = c.vehicle_id AND c.recorded_at >= o.onset
          JOIN vehicles v ON v.vehicle_id = c.vehicle_id
          LEFT JOIN baselines b ON b.model_code = v.model_code AND b.drive_mode = c.drive_mode AND b.metric_name = c.metric_name
          GROUP BY 1, 2),
    h AS (SELECT c.vehicle_id, arg_max(metric_value, (recorded_at, id)) AS latest_health FROM clean c JOIN onsets o ON o.vehicle_id = c.vehicle_id
          WHERE recorded_at >= onset AND metric_name = 'error' GROUP BY 1)
    SELECT m.vehicle_id, metric_name, latest_health, round(actual, 6) AS actual, round(baseline, 6) AS baseline,
           CASE WHEN baseline <> 0 THEN round(round((actual - baseline) / abs(baseline) * 100, 9), 1) + 0.0 END AS delta_pct FROM m LEFT JOIN h ON h.vehicle_id = m.vehicle_id""")
def since_onset(t):
    """The onset of a vehicle is its first impossible reading."""
    onsets = t.readings.where(F.col("quality_flag").isNotNull()).groupBy("vehicle_id").agg(F.min("recorded_at").alias("onset"))
    return diagnose.since_onset(t.clean, t.vehicles, t.baselines, onsets, "error").withColumn(
        "actual", F.round("actual", 6)).withColumn("baseline", F.round("baseline", 6))


@query("ag35_table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ["events", "orders", "lineitem", "documents", "customer"]))
def table_counts(t):
    counts = [getattr(t, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n"))
              for n in ["events", "orders", "lineitem", "documents", "customer"]]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# windows

@query("w01_ranks", """
    SELECT id, row_number() OVER (PARTITION BY vehicle_id ORDER BY metric_value DESC, id) AS row_no,
           rank() OVER (PARTITION BY vehicle_id ORDER BY metric_value DESC) AS rank_no,
           dense_rank() OVER (PARTITION BY vehicle_id ORDER BY metric_value DESC) AS dense_no FROM telemetry""")
def ranks(t):
    """Ranks over the distinct values of a key, carried to its rows."""
    df = t.telemetry.select("id", "vehicle_id", "metric_value")
    down = F.coalesce(-F.col("metric_value"), F.lit(float("inf")))  # a reading without a value comes last
    rows = skew.running(df, ["vehicle_id"], down, ["id"], {"row_no": F.lit(1)})
    values = df.groupBy("vehicle_id", "metric_value").agg(F.count("*").alias("_c"))
    values = skew.running(values, ["vehicle_id"], down, [], {"dense_no": F.lit(1), "_upto": F.col("_c")})
    values = values.withColumn("rank_no", F.col("_upto") - F.col("_c") + 1).drop("_c", "_upto")
    return skew.join_null_safe(rows, values, ["vehicle_id", "metric_value"], "inner").select("id", "row_no", "rank_no", "dense_no")


@query("w02_lag_lead", """
    SELECT id, lag(metric_value) OVER w AS previous, lead(metric_value) OVER w AS following FROM telemetry
    WINDOW w AS (PARTITION BY vehicle_id ORDER BY recorded_at, id)""")
def lag_lead(t):
    df = t.telemetry.select("id", "vehicle_id", us("recorded_at").alias("at"), "metric_value")
    df = skew.neighbour(df, ["vehicle_id"], F.col("at"), ["id"], {"previous": F.col("metric_value")})
    df = skew.neighbour(df, ["vehicle_id"], F.col("at"), ["id"], {"following": F.col("metric_value")}, following=True)
    return df.select("id", "previous", "following")


@query("w03_first_last", """
    SELECT DISTINCT vehicle_id, first_value(metric_value) OVER w AS first_value, last_value(metric_value) OVER w AS last_value
    FROM telemetry WINDOW w AS (PARTITION BY vehicle_id ORDER BY recorded_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def first_last(t):
    at = F.struct("recorded_at", "id")
    return t.telemetry.groupBy("vehicle_id").agg(
        F.min_by("metric_value", at).alias("first_value"), F.max_by("metric_value", at).alias("last_value"))


@query("w04_latest_reading", """
    SELECT vehicle_id, metric_name, arg_max(metric_value, (recorded_at, id)) AS latest_metric_value,
           max(recorded_at) AS latest_recorded_at FROM clean GROUP BY 1, 2""")
def latest_reading(t):
    return diagnose.latest(t.clean, ["vehicle_id", "metric_name"], "metric_value", "recorded_at", "id")


@query("w05_count_beside_rows", "SELECT id, count(*) OVER () AS n FROM clean")
def count_beside_rows(t):
    return t.clean.select("id", t.clean.agg(F.count("*")).scalar().alias("n"))


@query("w15_weekly_trend", """
    WITH b AS (SELECT time_bucket(INTERVAL '7 days', recorded_at) AS bucket, metric_name, avg(metric_value) AS mean FROM clean GROUP BY 1, 2)
    SELECT bucket, metric_name, round(mean, 6) AS mean,
           round(100 * (mean - lag(mean) OVER w) / abs(lag(mean) OVER w), 4) AS change_pct
    FROM b WINDOW w AS (PARTITION BY metric_name ORDER BY bucket)""")
def weekly_trend(t):
    weeks = rollup.rebucket(rollup.hourly(t.clean), 7 * 86400, ["metric_name"])
    return rollup.trend(weeks, ["metric_name"]).select(
        "bucket", "metric_name", F.round("avg_value", 6).alias("mean"), F.round("change_pct", 4).alias("change_pct"))


@query("w16_decline", """
    SELECT vehicle_id, metric_name, round(regr_slope(metric_value, epoch_us(recorded_at) / 86400000000.0), 4) AS per_day,
           count(*) AS readings FROM clean GROUP BY 1, 2 HAVING count(*) > 2""")
def decline(t):
    return diagnose.decline(t.clean, ["vehicle_id", "metric_name"]).where("readings > 2").select(
        "vehicle_id", "metric_name", F.round("per_day", 4).alias("per_day"), "readings")


@query("tk03_top_readings", "SELECT id, metric_value FROM telemetry ORDER BY metric_value DESC, id LIMIT 25")
def top_readings(t):
    return t.telemetry.select("id", "metric_value").orderBy(F.desc("metric_value"), "id").limit(25)


@query("tk04_top_per_vehicle", """
    SELECT vehicle_id, id, metric_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY metric_value DESC, id) AS rank
    FROM clean) WHERE rank <= 5""")
def top_per_vehicle(t):
    return skew.top_per_key(t.clean, ["vehicle_id"], [F.desc("metric_value"), F.col("id")], 5).select(
        "vehicle_id", "id", "metric_value", "rank")


@query("tk02_bounded_preview", "SELECT id, vehicle_id, metric_value FROM telemetry ORDER BY recorded_at DESC, id LIMIT 1000")
def bounded_preview(t):
    return src.bounded_preview(t.telemetry.select("id", "vehicle_id", "metric_value", "recorded_at"),
                               [F.desc("recorded_at"), F.col("id")], 5000).select("id", "vehicle_id", "metric_value")


@query("tk05_rows_and_more", """
    SELECT vehicle_id, string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS shown, greatest(count(*) - 3, 0) AS more
    FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY recorded_at, id) AS rank FROM telemetry) GROUP BY 1""")
def rows_and_more(t):
    """The first three rows of each vehicle and how many more there are."""
    first = skew.top_per_key(t.telemetry, ["vehicle_id"], [F.col("recorded_at"), F.col("id")], 3)
    shown = first.groupBy("vehicle_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("shown"))
    sizes = t.telemetry.groupBy("vehicle_id").agg(F.greatest(F.count("*") - 3, F.lit(0)).alias("more"))
    return shown.join(sizes, "vehicle_id")


@query("sf06_time_bucket", "SELECT id, time_bucket(INTERVAL '15 minutes', recorded_at) AS bucket FROM telemetry")
def time_bucket(t):
    return t.telemetry.select("id", timefn.time_bucket(900, F.col("recorded_at")).alias("bucket"))


@query("sf20_verdicts", """
    SELECT id, CASE WHEN nominal_value IS NULL THEN 'no_baseline'
        WHEN abs(round(round((metric_value - nominal_value) / abs(nominal_value) * 100, 9), 1)) <= coalesce(nullif(tolerance_pct, 0), 10) THEN 'normal'
        WHEN metric_value > nominal_value THEN 'above_normal' ELSE 'below_normal' END AS verdict
    FROM clean c JOIN vehicles v ON v.vehicle_id = c.vehicle_id
    LEFT JOIN baselines b ON b.model_code = v.model_code AND b.drive_mode = c.drive_mode AND b.metric_name = c.metric_name""")
def verdicts(t):
    rows = diagnose.with_baseline(t.clean, t.vehicles, t.baselines, "left")
    return rows.select("id", fr.verdict(F.col("metric_value"), F.col("nominal_value"), F.col("tolerance_pct")).alias("verdict"))


@query("sf33_pivot_unpivot", """
    SELECT vehicle_id, metric_name, round(avg(metric_value), 6) AS mean FROM clean GROUP BY 1, 2""")
def pivot_unpivot(t):
    """Long to wide by metric and back."""
    wide = t.clean.groupBy("vehicle_id").pivot("metric_name", METRICS).agg(F.round(F.avg("metric_value"), 6))
    return wide.unpivot("vehicle_id", METRICS, "metric_name", "mean").where(F.col("mean").isNotNull())


VERDICT = """CASE WHEN {b} IS NULL THEN 'no_baseline' WHEN {b} = 0 THEN 'not_applicable' WHEN abs({d}) <= coalesce(nullif({t}, 0), 10) THEN 'normal'
               WHEN {d} > 0 THEN 'above_normal' ELSE 'below_normal' END AS {n}_verdict"""


@query("dp39_fleet_report", """
    WITH j AS (SELECT c.*, v.model_code, b.nominal_value, b.rated_payload, b.tolerance_pct FROM clean c JOIN vehicles v ON v.vehicle_id = c.vehicle_id
          LEFT JOIN baselines b ON b.model_code = v.model_code AND b.drive_mode = c.drive_mode AND b.metric_name = c.metric_name),
    w AS (SELECT vehicle_id, model_code,
          avg(metric_value) FILTER (metric_name = 'click') AS ca, avg(nominal_value) FILTER (metric_name = 'click') AS cb,
          avg(metric_value) FILTER (metric_name = 'view') AS va, avg(nominal_value) FILTER (metric_name = 'view') AS vb,
          avg(metric_value) FILTER (metric_name = 'signup') AS sa, avg(nominal_value) FILTER (metric_name = 'signup') AS sb,
          max(tolerance_pct) FILTER (metric_name = 'click') AS ct, max(tolerance_pct) FILTER (metric_name = 'view') AS vt, max(tolerance_pct) FILTER (metric_name = 'signup') AS st,
          count(*) FILTER (metric_name = 'purchase' AND metric_value > rated_payload) AS overloads,
          arg_max(metric_value, (recorded_at, id)) FILTER (metric_name = 'error') AS health_last,
          arg_min(metric_value, (recorded_at, id)) FILTER (metric_name = 'error') AS health_first FROM j GROUP BY 1, 2),
    d AS (SELECT *, round(round((ca - cb) / abs(cb) * 100, 9), 1) + 0.0 AS cd, round(round((va - vb) / abs(vb) * 100, 9), 1) + 0.0 AS vd,
                 round(round((sa - sb) / abs(sb) * 100, 9), 1) + 0.0 AS sd FROM w)
    SELECT vehicle_id, model_code, round(ca, 6) AS click_actual, cd AS click_delta, vd AS view_delta, sd AS signup_delta,
           overloads, health_last, health_first,
           """ + VERDICT.format(b="cb", d="cd", t="ct", n="click") + ", " + VERDICT.format(b="vb", d="vd", t="vt", n="view") + ", " + VERDICT.format(b="sb", d="sd", t="st", n="signup") + """,
           CASE WHEN cd > 15 AND overloads > 0 THEN 'overload' WHEN health_last < health_first - 5 THEN 'cell_wear'
                WHEN vd < -15 THEN 'speed_cap' WHEN sd < -30 THEN 'charger_fault' WHEN cd > 15 THEN 'unexplained' ELSE 'normal' END AS scenario
    FROM d""")
def fleet_report(t):
    out = diagnose.fleet_report(t.clean, t.vehicles, t.baselines, "click", "view", "signup", "purchase", "error")
    return out.select("vehicle_id", "model_code", F.round("click_actual", 6).alias("click_actual"), "click_delta", "view_delta",
                      "signup_delta", "overloads", "health_last", "health_first", "click_verdict", "view_verdict", "signup_verdict", "scenario")


@query("pf14_pinned_day", """
    SELECT vehicle_id, count(*) FILTER (recorded_at >= TIMESTAMP '2024-01-15' - INTERVAL 7 DAY AND recorded_at < TIMESTAMP '2024-01-15') AS that_week,
           count(*) FILTER (recorded_at >= TIMESTAMP '2024-01-15' - INTERVAL 14 DAY AND recorded_at < TIMESTAMP '2024-01-15') AS two_weeks FROM telemetry
    WHERE recorded_at >= TIMESTAMP '2024-01-01' AND recorded_at < TIMESTAMP '2024-01-15' GROUP BY 1""")
def pinned_day(t):
    """The same question with another day taken for today."""
    as_of = "2024-01-15"
    rows = t.telemetry_since(src.days_before(as_of, 14), as_of)
    week = F.col("recorded_at") >= F.lit(src.days_before(as_of, 7)).cast("timestamp")
    return rows.groupBy("vehicle_id").agg(F.count(F.when(week, 1)).alias("that_week"), F.count("*").alias("two_weeks"))


@query("j02_three_way_join", """
    SELECT c.id, v.model_code, b.nominal_value FROM clean c JOIN vehicles v ON v.vehicle_id = c.vehicle_id
    JOIN baselines b ON b.model_code = v.model_code AND b.drive_mode = c.drive_mode AND b.metric_name = c.metric_name""")
def three_way_join(t):
    return diagnose.with_baseline(t.clean, t.vehicles, t.baselines).select("id", "model_code", "nominal_value")


@query("j04_using_join", "SELECT vehicle_id, region, count(*) AS readings FROM telemetry JOIN vehicles USING (vehicle_id) GROUP BY 1, 2")
def using_join(t):
    return t.telemetry.join(t.vehicles, on="vehicle_id").groupBy("vehicle_id", "region").agg(F.count("*").alias("readings"))


@query("w08_rank_positions", """
    SELECT id, row_number() OVER (PARTITION BY metric_name ORDER BY metric_value DESC, id) AS rank,
           round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY metric_name ORDER BY metric_value DESC, id)), 9) AS share FROM telemetry""")
def rank_positions(t):
    """Positions in a ranked list per metric; five metrics share all rows, so each list is cut into slices."""
    rows = t.telemetry.select("id", "metric_name", "metric_value")
    out = skew.running(rows, ["metric_name"], -F.col("metric_value"), ["id"], {"rank": F.lit(1)}, hot_rows=50_000)
    return out.select("id", "rank", F.round(1.0 / (60 + F.col("rank")), 9).alias("share"))
