"""Turns, feedback and service metrics. Every event stands for one turn: its
value for the latency and cost, its type and `k` for how it went."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens import session
from fleetlens.functions import timefn
from fleetlens.operators import feedback, matching, opsmetrics
from fleetlens.plans.bindings import CTES
from fleetlens.plans.registry import query

CTES["outcomes"] = """
    SELECT *, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'purchase' THEN 'cap_reached' WHEN 'signup' THEN 'exhausted' ELSE 'complete' END AS stop_reason,
      k > 90 AS partial, CASE WHEN k < 5 THEN NULL ELSE k >= 20 END AS grounded, k % 10 = 3 AS router_error, k % 10 = 7 AS step_error,
      k % 4 IN (1, 3) AS has_sql, k % 4 IN (2, 3) AS has_rag, k % 3 = 0 AS business, k % 5 = 0 AS lookup, k % 2 = 0 AS has_vehicle,
      value * 400 AS latency_ms, value / 10000 AS cost_usd, event_type = 'error' AND k > 50 AS failed
    FROM (SELECT event_id AS turn_id, user_id AS session_id, ts AS created_at, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
CTES["signed"] = """
    SELECT *, list_filter([CASE WHEN router_error OR (has_vehicle AND business) THEN 'wrong_domain' END,
        CASE WHEN (NOT has_sql AND NOT has_rag) OR (lookup AND NOT has_sql) THEN 'wrong_tool' END, CASE WHEN step_error THEN 'step_failed' END,
        CASE WHEN has_sql AND k > 80 THEN 'sql_failed' END, CASE WHEN has_rag AND k < 40 THEN 'empty_retrieval' END,
        CASE WHEN NOT grounded THEN 'grounding_failure' END, CASE WHEN stop_reason IN ('timeout', 'cap_reached') THEN 'hit_limit' END], lambda x: x IS NOT NULL) AS hits,
      CASE WHEN len(hits) > 0 THEN hits WHEN latency_ms > 20000 THEN ['slow'] ELSE ['no_signal'] END AS signals, signals[1] AS cluster FROM outcomes"""
CTES["flags"] = """
    SELECT turn_id * 10 AS id, turn_id, 'down' AS rating, created_at + INTERVAL 1 HOUR AS created_at,
           CASE WHEN k < 60 THEN 'new' WHEN k < 80 THEN 'dismissed' ELSE 'promoted' END AS review_status FROM outcomes WHERE value > 60
    UNION ALL SELECT turn_id * 10 + 1, turn_id, 'implicit_down', created_at + INTERVAL 2 HOUR, 'new' FROM outcomes WHERE value > 120
    UNION ALL SELECT turn_id * 10 + 2, turn_id, 'up', created_at, 'new' FROM outcomes WHERE value < 20"""


def outcomes(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select(F.col("event_id").alias("turn_id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"),
                           "event_type", "value", k.alias("k"))
    k, e = F.col("k"), F.col("event_type")
    stop = F.when(e == "error", "timeout").when(e == "purchase", "cap_reached").when(e == "signup", "exhausted").otherwise("complete")

    def strings(*items):
        return F.array_compact(F.array(*items))

    sql, rag = (k % 4).isin(1, 3), (k % 4).isin(2, 3)
    return rows.withColumns({
        "stop_reason": stop, "partial": k > 90, "grounded": F.when(k >= 5, k >= 20),
        "node_errors": strings(F.when(k % 10 == 3, F.lit("router: KeyError: x")), F.when(k % 10 == 7, F.lit("execute: ValueError: y"))),
        "tools_selected": strings(F.when(sql, F.lit("structured_query_tool")), F.when(rag, F.lit("rag_retrieval_tool"))),
        "evidence_statuses": strings(
            F.when(sql, F.when(k > 80, "structured_query_tool:failed").otherwise("structured_query_tool:ok")),
            F.when(rag, F.when(k < 40, "rag_retrieval_tool:below_threshold").otherwise("rag_retrieval_tool:ok"))),
        "domains": F.when(k % 3 == 0, F.array(F.lit("business"))).otherwise(F.array(F.lit("diagnostic"))),
        "query_type": F.when(k % 5 == 0, "lookup").otherwise("diagnose"), "vehicle_id": F.when(k % 2 == 0, F.concat(F.lit("V-"), F.col("session_id").cast("string"))),
        "latency_ms": F.col("value") * 400, "cost_usd": F.col("value") / 10000, "error": F.when((e == "error") & (k > 50), "TimeoutError")})


def recorded(t):
    """Turns with their outcome as JSON, the way they are stored."""
    o = outcomes(t)
    fields = ["stop_reason", "partial", "grounded", "node_errors", "tools_selected", "evidence_statuses", "domains", "query_type", "latency_ms", "cost_usd", "error"]
    return o.select("turn_id", "session_id", "created_at", "vehicle_id", F.to_json(F.struct(*fields)).alias("outcome"))


def signed(t):
    return feedback.signatures(recorded(t))


def flags(t):
    o = outcomes(t).select("turn_id", "created_at", "value", "k")
    hour = F.expr("INTERVAL 1 HOUR")
    review = F.when(F.col("k") < 60, "new").when(F.col("k") < 80, "dismissed").otherwise("promoted")

    def flag(no, rating, at, status):
        return F.when(F.lit(True), F.struct((F.col("turn_id") * 10 + no).alias("id"), F.lit(rating).alias("rating"), at.alias("created_at"), status.alias("review_status")))

    every = F.array_compact(F.array(
        F.when(F.col("value") > 60, flag(0, "down", F.col("created_at") + hour, review)),
        F.when(F.col("value") > 120, flag(1, "implicit_down", F.col("created_at") + hour + hour, F.lit("new"))),
        F.when(F.col("value") < 20, flag(2, "up", F.col("created_at"), F.lit("new")))))
    return o.select("turn_id", F.inline(every))


@query("dp20_failure_signatures", "SELECT turn_id, cluster, array_to_string(signals, ',') AS signals FROM signed")
def failure_signatures(t):
    return feedback.with_signature(recorded(t)).select("turn_id", "cluster", F.array_join("signals", ",").alias("signals"))


@query("j20_flagged_turns", "SELECT f.id, f.turn_id, rating, cluster FROM flags f JOIN signed s ON s.turn_id = f.turn_id WHERE rating <> 'up'")
def flagged_turns(t):
    return feedback.flagged_turns(flags(t), recorded(t)).select("id", "turn_id", "rating", "cluster")


@query("tk07_review_queue", """
    WITH o AS (SELECT cluster, s.turn_id, min(f.id) AS flag_id FROM flags f JOIN signed s ON s.turn_id = f.turn_id
               WHERE rating <> 'up' AND review_status = 'new' GROUP BY 1, 2)
    SELECT cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size, turn_id, flag_id, CASE WHEN flag_id % 10 = 0 THEN 'down' ELSE 'implicit_down' END AS rating FROM o""")
def review_queue(t):
    return feedback.queue(session.cut(feedback.flagged_turns(flags(t), recorded(t)), "flagged"))


def promoted(t, signatures):
    o = signatures.select("turn_id", "cluster").join(outcomes(t).select("turn_id", "created_at", "value"), "turn_id")
    rows = o.where("value > 150 AND cluster <> 'hit_limit'")
    cases = rows.select(F.concat(F.lit("prm_"), F.col("turn_id").cast("string")).alias("id"), "cluster", F.to_date("created_at").alias("promoted_on"))
    results = rows.where("value > 160 AND cluster <> 'wrong_tool'").select(
        F.concat(F.lit("prm_"), F.col("turn_id").cast("string")).alias("id"), ((F.col("value") < 180) | (F.col("cluster") != "wrong_domain")).alias("pass"))
    return cases, results


@query("ag26_cluster_status", """
    WITH items AS (SELECT s.cluster, f.* FROM flags f JOIN signed s ON s.turn_id = f.turn_id WHERE rating <> 'up'),
    p AS (SELECT cluster, created_at::DATE AS promoted_on, CASE WHEN value > 160 AND cluster <> 'wrong_tool' THEN value < 180 OR cluster <> 'wrong_domain' END AS pass
          FROM signed WHERE value > 150 AND cluster <> 'hit_limit'),
    l AS (SELECT cluster, max(promoted_on) AS last FROM p GROUP BY 1),
    f AS (SELECT i.cluster, count(DISTINCT turn_id) AS flags, count(*) FILTER (review_status = 'new') AS open, count(*) FILTER (review_status = 'dismissed') AS dismissed,
                 count(*) FILTER (created_at::DATE > last) AS new_since FROM items i LEFT JOIN l ON l.cluster = i.cluster GROUP BY 1),
    c AS (SELECT cluster, count(*) AS cases, count(*) FILTER (pass) AS passing, count(*) FILTER (NOT pass) AS failing FROM p GROUP BY 1),
    j AS (SELECT cluster, coalesce(flags, 0) AS flags, coalesce(open, 0) AS open, coalesce(dismissed, 0) AS dismissed, coalesce(new_since, 0) AS new_since,
                 coalesce(cases, 0) AS cases, coalesce(passing, 0) AS passing, coalesce(failing, 0) AS failing FROM f FULL JOIN c USING (cluster))
    SELECT *, cases - passing - failing AS not_yet_run, CASE WHEN cases > 0 AND passing = cases AND new_since = 0 THEN 'resolved' WHEN cases > 0 AND passing = cases THEN 'recurring'
      WHEN failing > 0 THEN 'fix in progress' WHEN cases > 0 THEN 'awaiting eval run' WHEN open > 0 THEN 'unreviewed' ELSE 'dismissed only' END AS state FROM j""")
def cluster_status(t):
    signatures = signed(t)
    cases, results = promoted(t, signatures)
    return feedback.cluster_status(feedback.flagged_turns(flags(t), signatures), cases, results)


@query("dp21_coverage_warnings", """
    WITH e AS (SELECT cluster, count(*) AS existing_cases FROM signed WHERE value > 150 AND cluster <> 'hit_limit' GROUP BY 1 HAVING count(*) >= 3)
    SELECT turn_id AS id, s.cluster, existing_cases FROM signed s JOIN e ON e.cluster = s.cluster WHERE value > 100 AND value <= 150""")
def coverage_warnings(t):
    signatures = signed(t)
    drafts = signatures.join(outcomes(t).select("turn_id", "value"), "turn_id").where("value > 100 AND value <= 150").select(
        F.col("turn_id").alias("id"), "cluster")
    return feedback.coverage_warnings(drafts, promoted(t, signatures)[0])


@query("dp21_similar_cases")
def similar_cases(t):
    """Benchmark items as drafts, against every stored document as a case: copies, near copies and cases that hold a draft's words."""
    drafts = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    cases = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    return matching.similar_cases(drafts, cases)


@query("dp19_current_ratings", """
    SELECT user_id AS turn_id, arg_max(CASE WHEN value > 50 THEN 'down' ELSE 'up' END, (ts, event_id)) AS rating,
           arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS category,
           arg_max('note ' || event_id, (ts, event_id)) FILTER (value > 100) AS comment, count(*) AS times FROM events GROUP BY 1""")
def current_ratings(t):
    """Many ratings of one turn become one; a later one without a comment keeps the earlier comment."""
    rows = t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("turn_id"), F.col("ts").alias("created_at"), F.when(F.col("value") > 50, "down").otherwise("up").alias("rating"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("category"),
        F.when(F.col("value") > 100, F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("comment"))
    return feedback.current_ratings(rows)


@query("w10_gap_to_previous_turn", """
    SELECT session_id, turn_id, lag(turn_id) OVER w AS previous_turn,
           epoch(created_at) - epoch(lag(coalesce(ended_at, created_at)) OVER w) AS gap_s
    FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY created_at, turn_id)""")
def gap_to_previous_turn(t):
    """J12/W10"""
    return feedback.previous_turn(t.turns).select("session_id", "turn_id", "previous_turn", "gap_s")


@query("dp18_rephrased_turns")
def rephrased_turns(t):
    return feedback.rephrased(t.turns)


@query("pf18_eligible_turns", """
    SELECT session_id, turn_id FROM turns WHERE length(answer) >= 40 AND NOT (session_id % 9 = 0)""")
def eligible_turns(t):
    rows = t.turns.withColumn("partial", F.col("session_id") % 9 == 0).withColumn("evidence_count", F.length("question"))
    return rows.where(feedback.eligible()).select("session_id", "turn_id")


@query("pf19_failures", """
    SELECT turn_id FROM outcomes WHERE router_error OR step_error OR failed OR coalesce(NOT grounded, false) OR partial OR stop_reason IN ('timeout', 'cap_reached')""")
def failures(t):
    return outcomes(t).where(feedback.is_failure()).select("turn_id")


# service metrics

@query("ag30_counters", "SELECT stop_reason, count(*) AS turns FROM outcomes GROUP BY 1")
def counters(t):
    return outcomes(t).groupBy("stop_reason").agg(F.count("*").alias("turns"))


BUCKETS = "(VALUES " + ", ".join(f"({b}::DOUBLE)" for b in ref.LATENCY_BUCKETS) + ", ('inf'::DOUBLE)) b(le)"
HIST = f"""h AS (SELECT stop_reason, le, count(*) FILTER (latency_ms / 1000 <= le) AS count FROM outcomes, {BUCKETS} GROUP BY 1, 2)"""
QUANTILE = """q AS (SELECT {keys}, le, count, lag(count, 1, 0) OVER w AS below, lag(le, 1, 0) OVER w AS from_, max(count) OVER (PARTITION BY {keys}) * 0.95 AS rank
    FROM h WINDOW w AS (PARTITION BY {keys} ORDER BY le))
    SELECT {keys}, round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN from_ ELSE from_ + (le - from_) * (rank - below) / nullif(count - below, 0) END, le), 6) AS p95 FROM q WHERE count >= rank GROUP BY ALL"""


def seconds(t):
    return outcomes(t).withColumn("latency_s", F.col("latency_ms") / 1000)


@query("ag31_latency_histogram", f"WITH {HIST} SELECT stop_reason, le::VARCHAR AS le, count FROM h")
def latency_histogram(t):
    h = opsmetrics.histogram(seconds(t), ["stop_reason"], "latency_s", ref.LATENCY_BUCKETS)
    return h.withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")))


@query("ag32_latency_quantile", f"WITH {HIST}, " + QUANTILE.format(keys="stop_reason"))
def latency_quantile(t):
    h = opsmetrics.histogram(seconds(t), ["stop_reason"], "latency_s", ref.LATENCY_BUCKETS)
    return opsmetrics.histogram_quantile(h, ["stop_reason"], 0.95).select("stop_reason", F.round("quantile", 6).alias("p95"))


@query("ag33_error_ratio", """
    SELECT time_bucket(INTERVAL '6 hours', created_at) AS bucket, round(count(*) FILTER (failed) / greatest(count(*), 1e-9), 6) AS error_ratio FROM outcomes GROUP BY 1""")
def error_ratio(t):
    o = outcomes(t)
    part = F.count(F.when(F.col("error").isNotNull(), 1))
    return o.groupBy(timefn.time_bucket(6 * 3600, F.col("created_at")).alias("bucket")).agg(F.round(opsmetrics.ratio(part, F.count("*")), 6).alias("error_ratio"))


@query("ag34_call_costs", """
    SELECT session_id, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, round(sum((i * coalesce(pi, 0) + o * coalesce(po, 0)) / 1e6), 6) AS cost_usd FROM (
      SELECT session_id, CASE event_type WHEN 'click' THEN 'gpt-oss-120b' WHEN 'view' THEN 'gpt-oss-20b' WHEN 'error' THEN 'qwen3.8-27b' ELSE 'other' END AS model,
             floor(value * 1000)::BIGINT AS i, k * 100 AS o FROM outcomes) c
    LEFT JOIN (VALUES ('gpt-oss-120b', 0.15::DOUBLE, 0.60::DOUBLE), ('gpt-oss-20b', 0.075, 0.30), ('qwen3.8-27b', 0.29, 0.59)) p(model, pi, po) ON p.model = c.model GROUP BY 1""")
def call_costs(t):
    model = F.element_at(F.create_map(*[F.lit(x) for x in (
        "click", "gpt-oss-120b", "view", "gpt-oss-20b", "error", "qwen3.8-27b", "purchase", "other", "signup", "other")]), F.col("event_type"))
    calls = outcomes(t).select("session_id", model.alias("model"), F.floor(F.col("value") * 1000).alias("input"), (F.col("k") * 100).alias("output"))
    return opsmetrics.call_costs(calls, opsmetrics.prices(t.spark), ["session_id"])


@query("w11_rolling_usage", """
    SELECT turn_id, (sum(k) OVER (PARTITION BY event_type ORDER BY epoch_us(date_trunc('second', created_at)) RANGE BETWEEN 3599000000 PRECEDING AND CURRENT ROW))::BIGINT AS used FROM outcomes""")
def rolling_usage(t):
    """Usage of the last hour next to every call, by kind."""
    rows = outcomes(t).select("turn_id", "event_type", "created_at", "k")
    return opsmetrics.rolling_sum(rows, ["event_type"], "created_at", "k", seconds=3600, span=6 * 3600).select("turn_id", "used")


@query("w12_failure_streaks", """
    WITH r AS (SELECT session_id, created_at, turn_id, value > 50 AS bad, sum((NOT value > 50)::INT) OVER (PARTITION BY session_id ORDER BY created_at, turn_id) AS g FROM outcomes)
    SELECT session_id, count(*) AS length, min(created_at) AS started, max(created_at) AS ended FROM r WHERE bad GROUP BY session_id, g HAVING count(*) >= 3""")
def failure_streaks(t):
    rows = outcomes(t).select("session_id", "turn_id", "created_at", "value")
    return opsmetrics.streaks(rows, ["session_id"], F.unix_micros("created_at"), ["turn_id"], F.col("value") > 50, 3, "created_at")


@query("st12_held_alerts", """
    WITH w AS (SELECT time_bucket(INTERVAL '1 hour', created_at) AS bucket, stop_reason, avg(latency_ms) / 1000 AS mean FROM outcomes GROUP BY 1, 2),
    l AS (SELECT *, epoch(bucket) / 3600 - row_number() OVER (PARTITION BY stop_reason ORDER BY bucket) AS island FROM w WHERE mean > 15)
    SELECT stop_reason, min(bucket) AS pending_since, max(bucket) AS last_seen, epoch(max(bucket)) - epoch(min(bucket)) AS held_s FROM l GROUP BY stop_reason, island HAVING held_s >= 7200""")
def held_alerts(t):
    """Hours of high mean latency that held for at least two hours."""
    w = outcomes(t).groupBy(F.date_trunc("hour", "created_at").alias("bucket"), "stop_reason").agg((F.avg("latency_ms") / 1000).alias("mean"))
    return opsmetrics.held_alerts(w, ["stop_reason"], "bucket", F.col("mean") > 15, 7200, 3600)


@query("j12_previous_turn", """
    SELECT session_id, turn_id, lag(question) OVER (PARTITION BY session_id ORDER BY created_at, turn_id) AS previous_question FROM turns""")
def previous_turn(t):
    return feedback.previous_turn(t.turns).select("session_id", "turn_id", "previous_question")
