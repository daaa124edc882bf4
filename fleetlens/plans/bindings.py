"""The tables the operators expect, mapped from the tables of a folder.

Every mapping stands twice: as DataFrames in `Tables`, as SQL in `CTES`."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import quality
from fleetlens.sources import tables as src

AS_OF = "2001-07-15"          # the pinned day of the sales questions
TELEMETRY_AS_OF = "2024-01-31"

METRICS = ["click", "error", "purchase", "signup", "view"]
MODELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MODES = ["Eco", "Normal", "Sport", "Turbo", "Charging"]
RANGES = [("click", 0.5, 150.0), ("error", 1.0, 140.0), ("purchase", 0.5, 150.0), ("signup", 0.5, 160.0)]

CTES = {
    "telemetry": """
        SELECT event_id AS id, user_id AS vehicle_id, ts AS recorded_at, event_type AS metric_name,
               value AS metric_value,
               CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 6
                    WHEN 0 THEN 'Eco' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Sport' WHEN 3 THEN 'Turbo'
                    WHEN 4 THEN 'Charging' END AS drive_mode
        FROM events""",
    "ranges": """
        SELECT * FROM (VALUES ('click', 0.5::DOUBLE, 150.0::DOUBLE), ('error', 1.0, 140.0), ('purchase', 0.5, 150.0),
                              ('signup', 0.5, 160.0)) r(metric_name, min_value, max_value)""",
    "readings": """
        SELECT t.*, CASE WHEN t.metric_value < r.min_value THEN 'below_physical_range'
                         WHEN t.metric_value > r.max_value THEN 'above_physical_range' END AS quality_flag
        FROM telemetry t LEFT JOIN ranges r ON r.metric_name = t.metric_name""",
    "clean": "SELECT * FROM readings WHERE quality_flag IS NULL",
    "vehicles": """
        SELECT c_custkey AS vehicle_id, c_mktsegment AS model_code, r_name AS region, c_acctbal AS odometer_km
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "baselines": """
        SELECT model_code, drive_mode, metric_name,
               40.0::DOUBLE + 2 * mi + di + 0.5 * oi AS nominal_value,
               CASE WHEN di = 0 THEN 0.0::DOUBLE WHEN di = 4 THEN NULL ELSE 15.0 END AS tolerance_pct,
               100.0::DOUBLE + 5 * oi AS rated_payload
        FROM (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) a(metric_name, mi),
             (VALUES ('Eco', 0), ('Normal', 1), ('Sport', 2), ('Turbo', 3), ('Charging', 4)) b(drive_mode, di),
             (VALUES ('AUTOMOBILE', 0), ('BUILDING', 1), ('FURNITURE', 2), ('HOUSEHOLD', 3), ('MACHINERY', 4)) c(model_code, oi)
        WHERE NOT (model_code = 'MACHINERY' AND drive_mode = 'Sport')""",
    "sales": """
        SELECT o_orderkey AS id, o_custkey AS vehicle_id, CAST(o_orderdate AS DATE) AS sold_on, region,
               o_orderpriority AS channel, o_totalprice AS unit_price, model_code, o_orderstatus AS status
        FROM orders JOIN vehicles v ON v.vehicle_id = o_custkey""",
    "turns": """
        SELECT u.conv_id AS session_id, u.turn AS turn_id, u.text AS question, a.text AS answer,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(u.conv_id * 3600 + u.turn * 11) AS created_at,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(u.conv_id * 3600 + a.turn * 11) AS ended_at
        FROM (SELECT * FROM conversations WHERE role = 'user') u
        LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
               ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""",
}


class Tables:
    """The tables of one folder, under the names the operators use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return src.read_table(self.spark, self.folder, name)

    def telemetry_since(self, start: str, end: str | None = None) -> DataFrame:
        return self._telemetry(src.since(self.events, "ts", start, end))

    @staticmethod
    def _telemetry(events: DataFrame) -> DataFrame:
        mode = F.element_at(
            F.array(*[F.lit(m) for m in MODES], F.lit(None).cast("string")),
            (F.get_json_object("props", "$.k").cast("long") % 6 + 1).cast("int"))
        return events.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("vehicle_id"),
            F.col("ts").cast("timestamp").alias("recorded_at"), F.col("event_type").alias("metric_name"),
            F.col("value").alias("metric_value"), mode.alias("drive_mode"))

    @cached_property
    def telemetry(self) -> DataFrame:
        return self._telemetry(self.events)

    @cached_property
    def ranges(self) -> DataFrame:
        return src.reference_rows(self.spark, "metric_name string, min_value double, max_value double", RANGES)

    @cached_property
    def readings(self) -> DataFrame:
        return quality.flag_readings(self.telemetry, self.ranges)

    @cached_property
    def clean(self) -> DataFrame:
        return quality.clean_readings(self.readings)

    @cached_property
    def baselines(self) -> DataFrame:
        rows = [
            (model, mode, metric, 40.0 + 2 * mi + di + 0.5 * oi, {0: 0.0, 4: None}.get(di, 15.0), 100.0 + 5 * oi)
            for mi, metric in enumerate(METRICS) for di, mode in enumerate(MODES) for oi, model in enumerate(MODELS)
            if not (model == "MACHINERY" and mode == "Sport")
        ]
        return src.reference_rows(
            self.spark,
            "model_code string, drive_mode string, metric_name string, nominal_value double, "
            "tolerance_pct double, rated_payload double", rows)

    @cached_property
    def vehicles(self) -> DataFrame:
        places = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("vehicle_id"), F.col("c_mktsegment").alias("model_code"),
            F.col("r_name").alias("region"), F.col("c_acctbal").alias("odometer_km"))

    @cached_property
    def sales(self) -> DataFrame:
        return self.orders.join(self.vehicles, F.col("o_custkey") == F.col("vehicle_id")).select(
            F.col("o_orderkey").alias("id"), "vehicle_id", F.to_date("o_orderdate").alias("sold_on"), "region",
            F.col("o_orderpriority").alias("channel"), F.col("o_totalprice").alias("unit_price"), "model_code",
            F.col("o_orderstatus").alias("status"))

    @cached_property
    def turns(self) -> DataFrame:
        talk = self.conversations
        user = talk.where("role = 'user'").select(
            F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), F.col("text").alias("question"))
        reply = talk.where("role = 'assistant'").select(
            F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("turn_id"), F.col("text").alias("answer"),
            F.col("turn").alias("_reply"))

        def at(turn):
            start = F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
            return F.timestamp_seconds(start + F.col("session_id") * 3600 + turn * 11)

        return user.join(reply, ["session_id", "turn_id"], "left").select(
            "session_id", "turn_id", "question", "answer",
            at(F.col("turn_id")).alias("created_at"), at(F.col("_reply")).alias("ended_at"))
