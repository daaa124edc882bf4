"""The streaming jobs, run over the stored tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens import session
from fleetlens.operators import opsmetrics, quality, rollup
from fleetlens.plans.library import NORM
from fleetlens.plans.registry import query
from fleetlens.plans.service import BUCKETS
from fleetlens.streaming import documents, metrics, runner, state, telemetry

HOURLY = """SELECT date_trunc('hour', recorded_at) AS hour, vehicle_id, metric_name, drive_mode, count(*) AS readings,
           round(sum(metric_value), 4) AS sum_value, round(avg(metric_value), 6) AS avg_value,
           min(metric_value) AS min_value, max(metric_value) AS max_value FROM clean GROUP BY 1, 2, 3, 4"""


def rounded(rows):
    return rows.withColumn("sum_value", F.round("sum_value", 4)).withColumn("avg_value", F.round("avg_value", 6))


def events(t):
    return runner.stream_table(t.spark, t.folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def readings(t):
    mode = F.element_at(F.array(*[F.lit(m) for m in ("Eco", "Normal", "Sport", "Turbo", "Charging")], F.lit(None).cast("string")),
                        (F.get_json_object("props", "$.k").cast("long") % 6 + 1).cast("int"))
    return events(t).select(F.col("event_id").alias("id"), F.col("user_id").alias("vehicle_id"), F.col("ts").alias("recorded_at"),
                            F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), mode.alias("drive_mode"))


@query("st01_flagged_on_arrival", "SELECT id, metric_value, quality_flag FROM readings")
def flagged_on_arrival(t):
    rows = telemetry.flagged(readings(t), t.ranges).select("id", "metric_value", "quality_flag")
    return runner.drain(rows, "flagged").drop("batch_id")


@query("st02_hourly_stream", HOURLY)
def hourly_stream(t):
    clean = quality.clean_readings(telemetry.flagged(readings(t), t.ranges))
    return rounded(telemetry.current_rollup(runner.drain(telemetry.hourly(clean), "rollup", "update")))


@query("st03_closed_hours", HOURLY + " HAVING hour + INTERVAL 1 HOUR <= (SELECT max(recorded_at) FROM clean) - INTERVAL 3 DAY")
def closed_hours(t):
    """Only hours that no late row can change any more: append mode."""
    clean = quality.clean_readings(telemetry.flagged(readings(t), t.ranges))
    return rounded(runner.drain(telemetry.hourly(clean), "closed").drop("batch_id"))


@query("st04_realtime_rollup", HOURLY)
def realtime_rollup(t):
    """Stored hours before 20 January, later ones computed from the readings."""
    stored = session.cut(rollup.hourly(t.clean.where(F.col("recorded_at") < "2024-01-20")), "hours")
    return rounded(rollup.realtime(stored, t.clean, "2024-01-20 00:00:00"))


@query("st05_late_rows", HOURLY)
def late_rows(t):
    """A rollup that missed some rows, brought up to date for the touched hours."""
    late = F.col("metric_value").between(50, 60)
    path = session.shared_dir(t.spark, "hours")
    rollup.store(rollup.hourly(t.clean.where(~late)), path)
    rollup.refresh_stored(t.clean, t.clean.where(late), path)
    return rounded(rollup.stored(t.spark, path))


def questions(t):
    talk = runner.stream_table(t.spark, t.folder, "conversations").where("role = 'user'")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 11)
    return talk.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("id"), at.alias("ts"),
                       F.lit(None).cast("timestamp").alias("ended"), F.col("text").alias("question"))


@query("st06_rephrased_stream")
def rephrased_stream(t):
    return runner.drain(state.rephrased(questions(t)), "rephrased").drop("batch_id")


@query("st09_paired_turns", """
    WITH s AS (SELECT conv_id * 1000 + turn AS key, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 11) AS started FROM conversations WHERE role = 'user'),
    e AS (SELECT conv_id * 1000 + turn - 1 AS key, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 11) AS ended FROM conversations WHERE role = 'assistant'),
    w AS (SELECT least((SELECT max(started) FROM s), (SELECT max(ended) FROM e)) - INTERVAL 10 MINUTE AS mark)
    SELECT s.key::VARCHAR AS key, started, ended FROM s LEFT JOIN e ON e.key = s.key
    WHERE ended IS NOT NULL OR started + INTERVAL 1 HOUR < (SELECT mark FROM w)""")
def paired_turns(t):
    """Turn starts with their ends; starts that stay alone come out once that is certain."""
    def rows(role, shift, name):
        talk = runner.stream_table(t.spark, t.folder, "conversations").where(F.col("role") == role)
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 11)
        return talk.select((F.col("conv_id") * 1000 + F.col("turn") - shift).cast("string").alias("key"), at.alias(name))

    return runner.drain(state.paired(rows("user", 0, "started"), rows("assistant", 1, "ended")), "paired").drop("batch_id")


@query("st10_sliding_ratio", """
    WITH w AS (SELECT unnest(range(0, 10)) AS i), x AS (SELECT time_bucket(INTERVAL '1 minute', ts) - to_minutes(i) AS start, event_type FROM events, w)
    SELECT start, count(*) AS total, count(*) FILTER (event_type = 'error') AS part, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio FROM x GROUP BY 1""")
def sliding_ratio(t):
    rows = metrics.sliding_ratio(events(t), "ts", F.col("event_type") == "error", "10 minutes", "1 minute")
    return runner.newest(runner.drain(rows, "ratio", "update"), ["start"]).withColumn("ratio", F.round("ratio", 6))


@query("st11_latency_quantiles", f"""
    WITH h AS (SELECT date_trunc('hour', ts) AS start, le, count(*) FILTER (value <= le) AS count FROM events, {BUCKETS} GROUP BY 1, 2),
    q AS (SELECT *, lag(count, 1, 0) OVER w AS below, lag(le, 1, 0) OVER w AS from_, max(count) OVER (PARTITION BY start) * 0.95 AS rank FROM h WINDOW w AS (PARTITION BY start ORDER BY le))
    SELECT start, round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN from_ ELSE from_ + (le - from_) * (rank - below) / nullif(count - below, 0) END, le), 6) AS p95 FROM q WHERE count >= rank GROUP BY 1""")
def latency_quantiles(t):
    windows = metrics.histograms(events(t), "ts", "value", ref.LATENCY_BUCKETS, "1 hour")
    rows = metrics.bucket_rows(runner.newest(runner.drain(windows, "histograms", "update"), ["start"]), ref.LATENCY_BUCKETS)
    return opsmetrics.histogram_quantile(rows, ["start"], 0.95).select("start", F.round("quantile", 6).alias("p95"))


@query("st12_alert_stream", """
    WITH w AS (SELECT date_trunc('hour', ts) AS start, count(*) FILTER (event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1),
    l AS (SELECT *, epoch(start) / 3600 - row_number() OVER (ORDER BY start) AS island FROM w WHERE ratio > 0.2)
    SELECT min(start) AS pending_since, max(start) AS last_seen, epoch(max(start)) - epoch(min(start)) AS held_s FROM l GROUP BY island HAVING held_s >= 7200""")
def alert_stream(t):
    """Hourly error ratios as a stream; alerts where a high one held for two hours."""
    rows = metrics.sliding_ratio(events(t), "ts", F.col("event_type") == "error", "1 hour", "1 hour")
    hours = runner.newest(runner.drain(rows, "alerts", "update"), ["start"]).withColumn("alert", F.lit("errors"))
    return opsmetrics.held_alerts(hours, ["alert"], "start", F.col("ratio") > 0.2, 7200, 3600).drop("alert")


@query("st13_document_stream", f"""
    WITH d AS (SELECT doc_id, sha256({NORM}) AS content_hash FROM documents)
    SELECT doc_id, content_hash, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY content_hash) THEN 'ingested' ELSE 'skipped_duplicate' END AS status FROM d""")
def document_stream(t):
    path = session.shared_dir(t.spark, "ledger")
    rows = runner.stream_table(t.spark, t.folder, "documents").select("doc_id", F.col("text").alias("raw"))
    runner.start(rows, documents.ingest_sink(path), "ledger").awaitTermination()
    return t.spark.read.schema(documents.LOG).parquet(path).drop("batch_id")


@query("st14_live_reviews", """
    SELECT d.doc_id AS turn_id, least(1 + 3 * quality, 4 - 3 * toxic) <= 2 AS flagged FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    WHERE length(text) >= 40 AND ('0x' || substr(sha256(d.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.5""")
def live_reviews(t):
    """Documents as answers: half of them drawn by hash, judged by their labels."""
    turns = runner.stream_table(t.spark, t.folder, "documents").select(
        F.col("doc_id").alias("turn_id"), F.col("text").alias("answer"), F.lit(False).alias("partial"), F.lit(1).alias("evidence_count"))
    scores = t.labels.select(F.col("doc_id").alias("turn_id"), (1 + 3 * F.col("quality")).alias("faithfulness"), (4 - 3 * F.col("toxic")).alias("hedging"))
    return runner.drain(metrics.live_reviews(turns, scores, ["faithfulness", "hedging"], 0.5).select("turn_id", "flagged"), "reviews").drop("batch_id")


@query("st15_sessions", """
    WITH g AS (SELECT user_id, ts, sum((gap IS NULL OR gap > INTERVAL 2 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
      SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)),
    s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS events FROM g GROUP BY user_id, s)
    SELECT * FROM s WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def sessions(t):
    """Sessions of two hours without an event, closed ones only."""
    return runner.drain(metrics.sessions(events(t), "user_id", "ts", "2 hours"), "sessions").drop("batch_id")


@query("st16_compacted_weeks", """
    SELECT time_bucket(INTERVAL '7 days', recorded_at)::DATE AS week, count(*) AS readings, count(DISTINCT vehicle_id) AS vehicles FROM readings GROUP BY 1""")
def compacted_weeks(t):
    """The layout job, then a read of the layout."""
    path = session.shared_dir(t.spark, "weeks")
    rollup.compact(t.readings, path)
    return t.spark.read.parquet(path).groupBy("week").agg(F.count("*").alias("readings"), F.count_distinct("vehicle_id").alias("vehicles"))
