"""Answers against evidence, and evaluation runs.

Answers are written from the telemetry of each vehicle: one answer per vehicle,
evidence from the top reading of each metric, with known mistakes in some of
them. Evaluation runs are read off the orders: a case per order, its checks from
the order's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import stats, text
from fleetlens.operators import audit, evaluation, skew
from fleetlens.plans.bindings import METRICS
from fleetlens.plans.registry import query

EVIDENCE = """evidence AS (SELECT c.vehicle_id AS answer_id, 'e' || (list_position(['click', 'error', 'purchase', 'signup', 'view'], c.metric_name)) AS evidence_id,
      CASE WHEN count(*) < 8 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN c.metric_name = 'view' THEN 'external' ELSE 'internal' END AS trust_level,
      max(metric_value) AS actual, max(nominal_value) AS baseline, CASE WHEN max(metric_value) > 140 THEN 'suspicious' END AS quality_warning,
      CASE WHEN max(nominal_value) IS NOT NULL THEN 'above_normal' END AS verdict,
      c.metric_name || ' tops at ' || CAST(max(metric_value) AS VARCHAR) || ' on 2024-01-31' AS summary
    FROM clean c JOIN vehicles v ON v.vehicle_id = c.vehicle_id
    LEFT JOIN baselines b ON b.model_code = v.model_code AND b.drive_mode = c.drive_mode AND b.metric_name = c.metric_name
    WHERE c.metric_name <> 'purchase' OR c.vehicle_id % 2 = 0 GROUP BY c.vehicle_id, c.metric_name)"""
ANSWERS = """answers AS (SELECT vehicle_id AS answer_id, 'How is vehicle V-' || vehicle_id || ' after 555.5 km?' AS question,
      'Top click reading is ' || coalesce(CAST(max(metric_value) FILTER (metric_name = 'click') AS VARCHAR), '0') || ' [e1].' AS s1,
      'Errors reach ' || coalesce(CAST(max(metric_value) FILTER (metric_name = 'error') AS VARCHAR), '0') || ' because of load, see [e2].' AS s2,
      CASE WHEN vehicle_id % 2 = 1 THEN 'Views peak at 987.6 due to traffic [e5].' ELSE 'The cause cannot be established because no document covers it [e4].' END AS s3,
      CASE WHEN vehicle_id % 3 = 0 THEN 'Purchases led to wear after 555.5 km [e9].' ELSE 'ERR_402 and 3 laps say nothing [e3].' END AS s4,
      vehicle_id % 5 = 0 AS partial, CASE WHEN vehicle_id % 7 = 0 THEN 'exhausted' ELSE 'complete' END AS stop_reason
    FROM clean GROUP BY vehicle_id)"""


def with_audit(*parts):
    return "WITH " + ", ".join((EVIDENCE, ANSWERS, *parts)) + " "


def evidence(t):
    from fleetlens.operators import diagnose
    rows = diagnose.with_baseline(t.clean, t.vehicles, t.baselines, "left").where("metric_name <> 'purchase' OR vehicle_id % 2 = 0")
    top = rows.groupBy("vehicle_id", "metric_name").agg(
        F.max("metric_value").alias("actual"), F.max("nominal_value").alias("baseline"), F.count("*").alias("n"))
    no = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric_name"))
    return top.select(
        F.col("vehicle_id").alias("answer_id"), F.concat(F.lit("e"), no.cast("string")).alias("evidence_id"),
        F.when(F.col("n") < 8, "empty").otherwise("ok").alias("status"),
        F.when(F.col("metric_name") == "view", "external").otherwise("internal").alias("trust_level"),
        F.lit(None).cast("string").alias("source_doc"), F.when(F.col("baseline").isNotNull(), "above_normal").alias("verdict"),
        F.when(F.col("actual") > 140, "suspicious").alias("quality_warning"),
        F.concat("metric_name", F.lit(" tops at "), F.col("actual").cast("string"), F.lit(" on 2024-01-31")).alias("summary"),
        "actual", "baseline", F.lit(None).cast("double").alias("delta_pct"), F.lit(None).cast("double").alias("rerank_score"))


def answers(t):
    def top(metric):
        return F.coalesce(F.max(F.when(F.col("metric_name") == metric, F.col("metric_value"))).cast("string"), F.lit("0"))

    v = F.col("vehicle_id")
    rows = t.clean.groupBy("vehicle_id").agg(top("click").alias("c"), top("error").alias("e"))
    s3 = F.when(v % 2 == 1, "Views peak at 987.6 due to traffic [e5].").otherwise("The cause cannot be established because no document covers it [e4].")
    s4 = F.when(v % 3 == 0, "Purchases led to wear after 555.5 km [e9].").otherwise("ERR_402 and 3 laps say nothing [e3].")
    return rows.select(
        v.alias("answer_id"), F.concat(F.lit("How is vehicle V-"), v.cast("string"), F.lit(" after 555.5 km?")).alias("question"),
        F.concat(F.lit("Top click reading is "), "c", F.lit(" [e1]. Errors reach "), "e", F.lit(" because of load, see [e2]. "), s3, F.lit("\n"), s4).alias("answer"),
        (v % 5 == 0).alias("partial"), F.when(v % 7 == 0, "exhausted").otherwise("complete").alias("stop_reason"))


CITED = """cited AS (SELECT answer_id, s1 AS sentence, 'e1' AS evidence_id FROM answers UNION ALL SELECT answer_id, s2, 'e2' FROM answers
    UNION ALL SELECT answer_id, s3, CASE WHEN answer_id % 2 = 1 THEN 'e5' ELSE 'e4' END FROM answers
    UNION ALL SELECT answer_id, s4, CASE WHEN answer_id % 3 = 0 THEN 'e9' ELSE 'e3' END FROM answers)"""


@query("dp22_citations", with_audit(CITED) + r"""
    SELECT answer_id, trim(regexp_replace(regexp_replace(sentence, '\[e\d+\]', ''), '\s+', ' ', 'g')) AS claim, evidence_id FROM cited""")
def citations(t):
    return audit.citations(answers(t))


@query("dp23_confidence", with_audit(CITED) + """
    SELECT a.answer_id, CASE WHEN a.partial OR n IS NULL THEN 'low' WHEN stop_reason = 'complete' AND n >= 2 THEN 'high' ELSE 'medium' END AS confidence
    FROM answers a LEFT JOIN (SELECT c.answer_id, count(DISTINCT c.evidence_id) AS n FROM cited c JOIN evidence e
      ON e.answer_id = c.answer_id AND e.evidence_id = c.evidence_id AND e.status = 'ok' GROUP BY 1) u ON u.answer_id = a.answer_id""")
def confidence(t):
    return audit.confidence(answers(t), evidence(t))


@query("dp24_unresolved_citations", with_audit(CITED) + """
    SELECT DISTINCT answer_id, evidence_id FROM cited c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.answer_id = c.answer_id AND e.evidence_id = c.evidence_id)""")
def unresolved(t):
    return audit.unresolved(answers(t), evidence(t))


@query("dp25_untraceable_numbers", with_audit() + """
    , pool AS (SELECT answer_id, evidence_id, unnest([actual, baseline]) AS p FROM evidence),
    n AS (SELECT answer_id, 987.6 AS v, '987.6' AS raw, 'e5' AS tag FROM answers WHERE answer_id % 2 = 1
          UNION ALL SELECT answer_id, CAST(regexp_extract(s1, 'is ([0-9.]+) ', 1) AS DOUBLE), regexp_extract(s1, 'is ([0-9.]+) ', 1), 'e1' FROM answers
          UNION ALL SELECT answer_id, CAST(regexp_extract(s2, 'reach ([0-9.]+) ', 1) AS DOUBLE), regexp_extract(s2, 'reach ([0-9.]+) ', 1), 'e2' FROM answers)
    SELECT DISTINCT answer_id, raw FROM n WHERE NOT (v = floor(v) AND v < 10) AND NOT EXISTS (
      SELECT 1 FROM pool p WHERE p.answer_id = n.answer_id AND p IS NOT NULL
        AND (p.evidence_id = n.tag OR NOT EXISTS (SELECT 1 FROM evidence e WHERE e.answer_id = n.answer_id AND e.evidence_id = n.tag))
        AND (abs(v - p) / p * 100 <= 1 OR round(v, length(split_part(raw, '.', 2))::INT) = round(p, length(split_part(raw, '.', 2))::INT)))""")
def untraceable(t):
    return audit.untraceable(answers(t), evidence(t))


@query("dp26_unsupported_causes", with_audit() + """
    , ok AS (SELECT answer_id, evidence_id FROM evidence WHERE status = 'ok' AND trust_level <> 'external' AND quality_warning IS NULL AND verdict IS NOT NULL)
    SELECT answer_id, s2 AS sentence FROM answers a WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.answer_id = a.answer_id AND evidence_id = 'e2')
    UNION ALL SELECT answer_id, s3 FROM answers WHERE answer_id % 2 = 1
    UNION ALL SELECT answer_id, s4 FROM answers WHERE answer_id % 3 = 0""")
def unsupported(t):
    return audit.unsupported_causes(answers(t), evidence(t))


@query("dp27_supports_cause", with_audit() + """
    SELECT answer_id, evidence_id, status = 'ok' AND trust_level <> 'external' AND quality_warning IS NULL AND verdict IS NOT NULL AS supports FROM evidence""")
def supports(t):
    return evidence(t).select("answer_id", "evidence_id", audit.supports_cause().alias("supports"))


@query("sf27_claimed_numbers", with_audit() + r"""
    SELECT answer_id, regexp_extract(s1, 'is ([0-9.]+) ', 1) || '|' || regexp_extract(s2, 'reach ([0-9.]+) ', 1)
      || CASE WHEN answer_id % 2 = 1 THEN '|987.6' ELSE '' END || CASE WHEN answer_id % 3 = 0 THEN '|555.5' ELSE '|3' END AS numbers FROM answers""")
def claimed_numbers(t):
    """Numbers of every answer; tags, codes and dates claim nothing."""
    return answers(t).select("answer_id", F.array_join(text.numbers(F.col("answer")), "|").alias("numbers"))


@query("sf32_tolerant_equality", """
    SELECT l_orderkey, l_linenumber, l_quantity <> 0 AND (round(l_extendedprice / l_quantity / 1000, 1) = round(l_quantity, 1)
        OR abs(l_extendedprice / l_quantity / 1000 - l_quantity) / l_quantity * 100 <= 5) AS traced FROM lineitem""")
def tolerant_equality(t):
    unit = F.col("l_extendedprice") / F.col("l_quantity") / 1000
    return t.lineitem.select("l_orderkey", "l_linenumber", text.traces(F.lit("0.0"), unit, F.col("l_quantity"), 5).alias("traced"))


@query("tk06_capped_evidence", with_audit() + """
    SELECT answer_id, evidence_id, kept_rank FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY status = 'ok', substr(evidence_id, 2)::INT DESC) AS kept_rank FROM evidence) WHERE kept_rank <= 3""")
def capped_evidence(t):
    from fleetlens.operators import feedback
    rows = evidence(t).withColumn("evidence_no", F.substring("evidence_id", 2, 9).cast("int"))
    return feedback.capped_evidence(rows, 3).select("answer_id", "evidence_id", "kept_rank")


@query("w17_numbered_evidence", """
    SELECT id, 'e' || row_number() OVER (PARTITION BY vehicle_id ORDER BY recorded_at, id) AS evidence_id FROM readings WHERE quality_flag IS NOT NULL""")
def numbered_evidence(t):
    """Every impossible reading of a vehicle, numbered in order of time."""
    rows = t.readings.where(F.col("quality_flag").isNotNull()).select("id", "vehicle_id", F.unix_micros("recorded_at").alias("at"))
    out = skew.running(rows, ["vehicle_id"], F.col("at"), ["id"], {"n": F.lit(1)})
    return out.select("id", F.concat(F.lit("e"), F.col("n").cast("string")).alias("evidence_id"))


CHECKS = """checked AS (SELECT answer_id, partial, stop_reason,
      s1 || ' ' || s2 || ' ' || s3 || chr(10) || s4 AS answer, answer_id % 2 = 1 AS odd, answer_id % 3 = 0 AS third FROM answers),
    c AS (SELECT answer_id, 'stop_reason' AS name, stop_reason = 'complete' AS passed FROM checked
      UNION ALL SELECT answer_id, 'iterations', answer_id % 4 <= 2 FROM checked
      UNION ALL SELECT answer_id, 'must_contain', third FROM checked
      UNION ALL SELECT answer_id, 'must_not_contain', NOT odd FROM checked
      UNION ALL SELECT answer_id, 'facts', third FROM checked
      UNION ALL SELECT answer_id, 'tools', true FROM checked
      UNION ALL SELECT answer_id, 'key_args', answer_id % 10 <> 1 FROM checked
      UNION ALL SELECT answer_id, 'abstain', partial OR NOT odd FROM checked WHERE answer_id % 2 = 0
      UNION ALL SELECT answer_id, 'citations', NOT third FROM checked)"""


def checked_answers(t):
    v = F.col("answer_id")
    expected = F.from_json(F.to_json(F.struct(
        F.lit(2).alias("max_iterations"), F.array(F.lit("complete")).alias("stop_reasons"),
        F.array(F.struct(F.lit("km").alias("label"), F.lit(-555.0).alias("value"), F.lit(0.6).alias("tolerance"))).alias("facts"),
        F.array(F.array(F.lit("because")), F.array(F.lit("missing"), F.lit("LED  to wear"))).alias("must_contain"),
        F.array(F.lit("987.6")).alias("must_not_contain"), F.array(F.lit("structured_query_tool")).alias("tools"),
        F.array(F.struct(F.lit("structured_query_tool").alias("tool"), F.array(F.lit("vehicle"), F.lit("top")).alias("contains"))).alias("key_args"),
        (v % 2 == 0).alias("abstain"))), audit.EXPECTED)
    args = F.when(v % 10 == 1, '{"sql": "select 1"}').otherwise('{"sql": "select TOP from Vehicle"}')
    calls = F.array(F.struct(F.lit("structured_query_tool").alias("tool"), args.alias("args")))
    return answers(t).select(
        "answer_id", "answer", "partial", "stop_reason", F.array().cast("array<string>").alias("domains"), F.lit(None).cast("string").alias("vehicle_id"),
        calls.alias("calls"), (v % 4).cast("int").alias("iterations"), F.lit(None).cast("boolean").alias("grounded"),
        F.regexp_extract_all("answer", F.lit(text.TAG), 1).alias("cited"), F.array(*[F.lit(f"e{i}") for i in range(1, 6)]).alias("evidence_ids"),
        expected.alias("expected"))


@query("dp28_answer_checks", with_audit(CHECKS) + "SELECT answer_id, name, passed FROM c")
def answer_checks(t):
    """Only what a case asks for is checked."""
    return audit.run_checks(checked_answers(t)).select("answer_id", F.inline("checks"))


@query("dp28_code_pass", with_audit(CHECKS) + "SELECT answer_id, bool_and(passed) AS code_pass FROM c GROUP BY 1")
def code_pass(t):
    return audit.run_checks(checked_answers(t)).select("answer_id", "code_pass")


@query("dp29_traps", with_audit(CHECKS) + "SELECT answer_id, partial OR NOT odd AS abstained, odd AS ungrounded_truth FROM checked")
def traps(t):
    rows = answers(t).withColumn("known_answer", F.array(F.lit("peak  at 987.6"), F.lit("nothing like it")))
    return audit.score_traps(rows).select("answer_id", "abstained", "ungrounded_truth")


@query("dp32_sanitised", """
    SELECT p_partkey, CASE WHEN p_size = 0 THEN '' ELSE '' END || p_type AS phrases,
           concat_ws('|', CASE WHEN p_size <> 7 AND p_size <> 0 THEN p_size::DOUBLE::VARCHAR END,
                          CASE WHEN p_retailprice <> 7 AND p_retailprice <> p_size THEN p_retailprice::VARCHAR END) AS facts FROM part""")
def sanitised(t):
    """Expectations about parts: a phrase with a number, a plain one, a long one."""
    cases = t.part.select(
        "p_partkey", F.lit("Which part has 7 holes?").alias("question"),
        F.array(F.concat(F.col("p_size").cast("string"), F.lit(" mm")), F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit("far too many words")).alias("must_contain"),
        F.array(F.col("p_retailprice"), F.lit(0.0), F.lit(7.0)).alias("facts"))
    return audit.sanitised(cases).select("p_partkey", F.array_join("must_contain", "|").alias("phrases"),
                                         F.array_join(F.transform("facts", lambda x: x.cast("string")), "|").alias("facts"))


@query("dp33_overrides", """
    SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 AND c_nationkey < 12 THEN 'poor' ELSE c_mktsegment END AS expected, CASE WHEN c_acctbal < 0 THEN 'balance' END AS override FROM customer""")
def overrides(t):
    cases = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("expected"))
    fixes = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 12, "poor").alias("expected"), F.lit("balance").alias("reason"))
    return audit.apply_overrides(cases, fixes, ["expected"])


@query("dp33_stale_overrides", "SELECT DISTINCT c_custkey AS id, 'no events' AS reason FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def stale_overrides(t):
    fixes = t.customer.select(F.col("c_custkey").alias("id"), F.lit("no events").alias("reason"))
    return audit.stale_overrides(t.events.select(F.col("user_id").alias("id")).distinct(), fixes)


@query("dp34_filled_facts", """
    SELECT c_custkey AS id, 'The ' || r_name || ' has ' || n || ' customers.' AS reference_answer FROM customer
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    JOIN (SELECT region, count(*) AS n FROM vehicles GROUP BY 1) f ON f.region = r_name""")
def filled_facts(t):
    facts = t.vehicles.groupBy(F.col("region").alias("label")).agg(F.count("*").cast("double").alias("value"))
    cases = t.vehicles.select(F.col("vehicle_id").alias("id"), F.col("region").alias("label"),
                              F.concat(F.lit("The  "), "region", F.lit(" has {"), "region", F.lit("}  customers.")).alias("reference_answer"))
    return audit.fill_facts(cases, facts).select("id", "reference_answer")


@query("dp36_case_audit", """
    SELECT 'empty_question' AS rule, count(*) FILTER (answer = '') AS cases FROM (SELECT CASE WHEN l_tax = 0 THEN '' ELSE 'x' END AS answer FROM lineitem)
    UNION ALL SELECT 'empty_reference', 0 UNION ALL SELECT 'fact_without_value', count(*) FILTER (l_discount = 0) FROM lineitem
    UNION ALL SELECT 'duplicate_id', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def case_audit(t):
    cases = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_tax") == 0, " ").otherwise("x").alias("question"),
        F.lit("y").alias("reference_answer"), F.array(F.nullif("l_discount", F.lit(0.0))).alias("facts"))
    return audit.audit_cases(cases)


# evaluation runs

RUNS = """lines AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, max(l_tax) AS tax, max(l_discount) AS discount, count(*) AS n,
      max(l_linenumber)::INT AS lines FROM lineitem GROUP BY 1),
    run AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'synthetic_sql' WHEN '2-HIGH' THEN 'synthetic_doc' WHEN '3-MEDIUM' THEN 'adversarial'
      WHEN '4-NOT SPECIFIED' THEN 'promoted' ELSE 'trap' END AS source, CASE WHEN o_totalprice < 20000 THEN 'infra' ELSE 'ok' END AS status, o_orderstatus,
      NOT returned AS citations, discount <= 0.09 AS facts, n >= 3 AS tools, tax > 0.06 AS judged_well, least(4, 1 + lines // 2) AS faithfulness, least(4, 1 + n // 2) AS hedging
      FROM orders JOIN lines ON l_orderkey = o_orderkey),
    now_ AS (SELECT *, citations AND facts AND (tools OR o_orderstatus = 'O') AS code_pass, citations AND facts AND (tools OR o_orderstatus = 'O') AND judged_well AS pass FROM run),
    then_ AS (SELECT id, status, facts AND judged_well AS pass FROM run WHERE o_orderstatus <> 'P'),
    scored AS (SELECT *, CASE WHEN source LIKE 'synthetic%' THEN 'synthetic' WHEN source IN ('adversarial', 'promoted') THEN 'handwritten' END AS fam FROM now_ WHERE status = 'ok' AND source <> 'trap')"""
WILSON = """SELECT grp, n, passed, round(100 * p, 1) AS pass_rate, round(100 * code / n, 1) AS code_rate, round(100 * greatest(0, centre - half), 1) AS low, round(100 * least(1, centre + half), 1) AS high
    FROM (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS centre, z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) / (1 + z * z / n) AS half
      FROM (SELECT *, 1.959963984540054::DOUBLE AS z, passed / n AS p FROM groups))"""
GROUPS = """groups AS (SELECT grp, count(*) AS n, count(*) FILTER (pass) AS passed, count(*) FILTER (code_pass) AS code FROM (
      SELECT 'all' AS grp, pass, code_pass FROM scored UNION ALL SELECT fam, pass, code_pass FROM scored WHERE fam IS NOT NULL
      UNION ALL SELECT 'source:' || source, pass, code_pass FROM scored) GROUP BY 1)"""


def with_runs(*parts):
    return "WITH " + ", ".join((RUNS, *parts)) + " "


def runs(t):
    """The current run over all orders, and the previous one over the orders that are not pending."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.max("l_tax").alias("tax"), F.max("l_discount").alias("discount"),
        F.count("*").alias("n"), F.max("l_linenumber").alias("lines"))
    source = F.element_at(F.create_map(*[F.lit(x) for x in (
        "1-URGENT", "synthetic_sql", "2-HIGH", "synthetic_doc", "3-MEDIUM", "adversarial", "4-NOT SPECIFIED", "promoted", "5-LOW", "trap")]), F.col("o_orderpriority"))
    tools = F.when(F.col("o_orderstatus") != "O", F.struct(F.lit("tools").alias("name"), (F.col("n") >= 3).alias("passed")))
    checks = F.array_compact(F.array(
        F.struct(F.lit("citations").alias("name"), (~F.col("returned")).alias("passed")),
        F.struct(F.lit("facts").alias("name"), (F.col("discount") <= 0.09).alias("passed")), tools))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), source.alias("source"), F.when(F.col("o_totalprice") < 20000, "infra").otherwise("ok").alias("status"),
        checks.alias("checks"), (F.col("tax") > 0.06).alias("judge_pass"), "o_orderstatus", (F.col("discount") <= 0.09).alias("_facts"),
        F.least(F.lit(4), 1 + F.floor(F.col("lines") / 2)).cast("int").alias("faithfulness"), F.least(F.lit(4), 1 + F.floor(F.col("n") / 2)).cast("int").alias("hedging"),
        F.array(F.concat(F.lit("cluster:"), "o_orderstatus"), F.lit("any")).alias("tags"))
    now = rows.withColumn("code_pass", F.forall("checks", lambda c: c["passed"])).withColumn("pass", F.col("code_pass") & F.col("judge_pass"))
    then = rows.where("o_orderstatus <> 'P'").withColumn("pass", F.col("_facts") & F.col("judge_pass"))
    return now, then


@query("ag14_pass_rate", with_runs() + "SELECT source, count(*) AS n, round(100 * avg(pass::INT), 1) AS pass_rate FROM now_ WHERE status = 'ok' GROUP BY 1")
def pass_rate(t):
    return runs(t)[0].where("status = 'ok'").groupBy("source").agg(F.count("*").alias("n"), stats.pass_rate(F.col("pass")).alias("pass_rate"))


@query("ag15_cluster_rates", with_runs() + "SELECT 'cluster:' || o_orderstatus AS tag, count(*) AS n, round(100 * avg(pass::INT), 1) AS pass_rate FROM scored GROUP BY 1")
def cluster_rates(t):
    return evaluation.cluster_rates(runs(t)[0])


@query("ag16_wilson_intervals", with_runs(GROUPS) + WILSON)
def wilson_intervals(t):
    """Rates and intervals of all, of each family, of each source (AG14, AG15, AG16)."""
    return evaluation.pass_rates(runs(t)[0])


@query("ag20_failure_tally", with_runs() + """
    SELECT check_name, count(*) AS failures FROM (SELECT 'citations' AS check_name FROM scored WHERE NOT citations UNION ALL SELECT 'facts' FROM scored WHERE NOT facts
      UNION ALL SELECT 'tools' FROM scored WHERE NOT tools AND o_orderstatus <> 'O') GROUP BY 1""")
def failure_tally(t):
    return evaluation.failure_tally(runs(t)[0])


@query("ag21_judge_means", with_runs() + "SELECT 'faithfulness' AS dimension, round(avg(faithfulness), 2) AS mean FROM scored UNION ALL SELECT 'hedging', round(avg(hedging), 2) FROM scored")
def judge_means(t):
    return evaluation.judge_means(runs(t)[0], ["faithfulness", "hedging"])


@query("ag22_headline", with_runs(GROUPS) + f"""
    SELECT pass_rate AS headline_pass_rate, grp AS headline_group, low, high FROM ({WILSON}) WHERE grp IN ('synthetic', 'handwritten') ORDER BY pass_rate, grp DESC LIMIT 1""")
def headline(t):
    return evaluation.headline(evaluation.pass_rates(runs(t)[0]))


@query("j07_run_diff", with_runs() + """
    SELECT n.id, CASE WHEN p.pass THEN 'regression' ELSE 'fixed' END AS change,
      CASE WHEN p.pass THEN concat_ws(',', CASE WHEN NOT n.citations THEN 'citations' END, CASE WHEN NOT n.facts THEN 'facts' END,
        CASE WHEN NOT n.tools AND n.o_orderstatus <> 'O' THEN 'tools' END, CASE WHEN NOT judged_well THEN 'judge' END) ELSE '' END AS now_failing
    FROM now_ n JOIN then_ p ON p.id = n.id WHERE n.status = 'ok' AND p.status = 'ok' AND n.pass <> p.pass""")
def run_diff(t):
    now, then = runs(t)
    return evaluation.diff_runs(now, then)


RATINGS = """least(4, 1 + floor(l_quantity / 13))::INT AS human, least(4, 1 + floor(l_extendedprice / 25000))::INT AS judge"""


def ratings(t):
    return t.lineitem.select(F.least(F.lit(4), 1 + F.floor(F.col("l_quantity") / 13)).cast("int").alias("human_helpfulness"),
                             F.least(F.lit(4), 1 + F.floor(F.col("l_extendedprice") / 25000)).cast("int").alias("judge_helpfulness"))


KAPPA = """round(1 - (count(*)::DOUBLE * sum((x - y) * (x - y))) / (count(*)::DOUBLE * (sum(x * x) + sum(y * y)) - 2::DOUBLE * sum(x) * sum(y)), 3)"""


@query("ag17_weighted_kappa", f"SELECT quality AS grp, {KAPPA} AS kappa, count(*) AS n FROM (SELECT doc_id % 4 AS quality, quality AS x, toxic AS y FROM labels) GROUP BY 1")
def weighted_kappa(t):
    """Agreement of two binary ratings, per group of documents."""
    return t.labels.groupBy((F.col("doc_id") % 4).alias("quality")).agg(
        stats.weighted_kappa(F.col("quality"), F.col("toxic")).alias("kappa"), F.count("*").alias("n")).withColumnRenamed("quality", "grp")


@query("ag18_agreement", f"""
    SELECT 'helpfulness' AS dimension, count(*) AS n, round(100 * avg((human = judge)::INT), 1) AS exact_pct, round(100 * avg((abs(human - judge) <= 1)::INT), 1) AS within_one_pct,
           {KAPPA.replace('(x - y)', '(human - judge)').replace('x * x', 'human * human').replace('y * y', 'judge * judge').replace('sum(x)', 'sum(human)').replace('sum(y)', 'sum(judge)')} AS kappa
    FROM (SELECT {RATINGS} FROM lineitem)""")
def agreement(t):
    return evaluation.agreement(ratings(t), ["helpfulness"])


@query("ag19_observed_counts", f"""
    SELECT human AS human_helpfulness, count(*) FILTER (judge = 1) AS "1", count(*) FILTER (judge = 2) AS "2", count(*) FILTER (judge = 3) AS "3", count(*) FILTER (judge = 4) AS "4"
    FROM (SELECT {RATINGS} FROM lineitem) GROUP BY 1""")
def observed_counts(t):
    return evaluation.observed_counts(ratings(t), "human_helpfulness", "judge_helpfulness", [1, 2, 3, 4])


@query("j19_case_result_label", """
    SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN embeddings e ON e.vec_id = d.doc_id""")
def case_result_label(t):
    """Three tables by one id."""
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    return t.documents.join(t.labels, "doc_id").join(e, "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("dp35_report", with_runs(GROUPS, f"r AS ({WILSON})") + """
    SELECT 'counts' AS section, 'cases' AS name, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'counts', 'scored', count(*) FILTER (status = 'ok') FROM now_
    UNION ALL SELECT 'counts', 'infra', count(*) FILTER (status = 'infra') FROM now_ UNION ALL SELECT 'counts', 'not_yet_run', (SELECT count(*) FROM orders) - count(*) FROM now_
    UNION ALL SELECT 'pass_rate', grp, pass_rate FROM r UNION ALL SELECT 'low', grp, low FROM r UNION ALL SELECT 'high', grp, high FROM r
    UNION ALL (SELECT 'headline', grp, pass_rate FROM r WHERE grp IN ('synthetic', 'handwritten') ORDER BY pass_rate, grp DESC LIMIT 1)
    UNION ALL SELECT 'check_failures', k, count(*) FROM (SELECT 'citations' AS k FROM scored WHERE NOT citations UNION ALL SELECT 'facts' FROM scored WHERE NOT facts
      UNION ALL SELECT 'tools' FROM scored WHERE NOT tools AND o_orderstatus <> 'O') GROUP BY k
    UNION ALL SELECT 'judge', 'faithfulness', round(avg(faithfulness), 2) FROM scored UNION ALL SELECT 'judge', 'hedging', round(avg(hedging), 2) FROM scored
    UNION ALL SELECT 'diff', CASE WHEN p.pass THEN 'regression' ELSE 'fixed' END, count(*) FROM now_ n JOIN then_ p ON p.id = n.id
      WHERE n.status = 'ok' AND p.status = 'ok' AND n.pass <> p.pass GROUP BY 2""")
def report(t):
    now, then = runs(t)
    return evaluation.report(t.orders, now, then, ["faithfulness", "hedging"])


@query("dp38_interval_overlap", with_runs(GROUPS, f"r AS ({WILSON})") + """
    SELECT a.grp AS grp_a, b.grp AS grp_b, a.low <= b.high AND b.low <= a.high AS within_noise FROM r a JOIN r b ON b.grp = 'all' AND a.grp <> 'all'""")
def interval_overlap(t):
    """Whether a group's rate differs from that of all by more than noise."""
    r = evaluation.pass_rates(runs(t)[0])
    whole = r.where("grp = 'all'")
    low, high = whole.select("low").scalar(), whole.select("high").scalar()
    overlap = stats.intervals_overlap(F.col("low"), F.col("high"), low, high)
    return r.where("grp <> 'all'").select(F.col("grp").alias("grp_a"), F.lit("all").alias("grp_b"), overlap.alias("within_noise"))



@query("j21_number_matches", with_audit() + """
    SELECT e.answer_id, e.evidence_id, count(*) AS matches FROM evidence e
    JOIN (SELECT answer_id, CAST(regexp_extract(s1, 'is ([0-9.]+) ', 1) AS DOUBLE) AS v FROM answers
          UNION ALL SELECT answer_id, CAST(regexp_extract(s2, 'reach ([0-9.]+) ', 1) AS DOUBLE) FROM answers) n
      ON n.answer_id = e.answer_id AND (abs(v - actual) / actual * 100 <= 1) AND n.v >= 10 GROUP BY 1, 2""")
def number_matches(t):
    """Written numbers joined to the readings they agree with, within one percent."""
    claimed = audit.claimed_numbers(answers(t)).where("size(tags) > 0 AND array_contains(array('e1', 'e2'), tags[0]) AND value >= 10")
    e = evidence(t).select("answer_id", "evidence_id", "actual")
    near = F.abs(F.col("value") - F.col("actual")) / F.col("actual") * 100 <= 1
    return claimed.join(e, "answer_id").where(near).groupBy("answer_id", "evidence_id").agg(F.count("*").alias("matches"))


@query("ud06_aggregate_functions", f"""
    SELECT l_returnflag, {KAPPA.replace('(x - y)', '(human - judge)').replace('x * x', 'human * human').replace('y * y', 'judge * judge').replace('sum(x)', 'sum(human)').replace('sum(y)', 'sum(judge)')} AS kappa,
           count(*) FILTER (human = judge) AS same, count(*) AS n FROM (SELECT l_returnflag, {RATINGS} FROM lineitem) GROUP BY 1""")
def aggregate_functions(t):
    """Kappa as a plain aggregate next to built-in ones, per group."""
    h, j = F.least(F.lit(4), 1 + F.floor(F.col("l_quantity") / 13)).cast("int"), F.least(F.lit(4), 1 + F.floor(F.col("l_extendedprice") / 25000)).cast("int")
    return t.lineitem.groupBy("l_returnflag").agg(stats.weighted_kappa(h, j).alias("kappa"), F.count(F.when(h == j, 1)).alias("same"), F.count("*").alias("n"))
