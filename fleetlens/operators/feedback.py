"""Ratings, rephrased questions, failure clusters and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens import session
from fleetlens.functions import fuzzy
from fleetlens.operators import skew

OUTCOME = """stop_reason string, iterations int, partial boolean, grounded boolean, error string, tools_selected array<string>,
    evidence_statuses array<string>, domains array<string>, query_type string, node_errors array<string>, latency_ms double, cost_usd double"""
#: Clusters are the fixed names of CLUSTER_ORDER, so a row for each is always small enough to send.
NEGATIVE = ["down", "implicit_down", "judge_low"]


def previous_turn(turns: DataFrame) -> DataFrame:
    """Each turn with the question of the session's previous turn and the
    seconds since that one ended. turns: session_id, turn_id, question,
    created_at, ended_at."""
    at = F.unix_micros("created_at")
    rows = turns.withColumn("_at", at).withColumn("_end", F.unix_micros(F.coalesce("ended_at", "created_at")))
    rows = skew.neighbour(rows, ["session_id"], F.col("_at"), ["turn_id"], {
        "previous_turn": F.col("turn_id"), "previous_question": F.col("question"), "_previous_end": F.col("_end")})
    return rows.withColumn("gap_s", (F.col("_at") - F.col("_previous_end")) / 1_000_000).drop("_at", "_end", "_previous_end")


def rephrased(turns: DataFrame, window_s: float = ref.REPHRASE_WINDOW_S, similarity: float = ref.REPHRASE_SIMILARITY,
              flags: DataFrame | None = None) -> DataFrame:
    """DP18: turns whose question was soon asked again in other words. The gap is
    tested first, so that only near turns reach the scorer. A turn that has an implicit flag in `flags`
    (turn_id, rating) already gets no second one."""
    near = previous_turn(turns).where((F.col("gap_s") >= 0) & (F.col("gap_s") <= window_s))
    if flags is not None:
        had = flags.where("rating = 'implicit_down'").select(F.col("turn_id").alias("previous_turn"))
        near = near.join(had, "previous_turn", "left_anti")
    scored = near.withColumn("similarity", fuzzy.token_set_ratio(F.lower("previous_question"), F.lower("question")))
    return scored.where(F.col("similarity") >= similarity).select(
        "session_id", F.col("previous_turn").alias("turn_id"), F.lit("implicit_down").alias("rating"), F.lit("rephrased").alias("category"),
        "gap_s", F.substring(F.concat(F.lit("asked again "), F.round("gap_s").cast("long").cast("string"), F.lit("s later: "), F.col("question")), 1, 500).alias("comment"))


def current_ratings(ratings: DataFrame) -> DataFrame:
    """DP19: one explicit rating per turn: the newest, with the newest category
    and comment that were given. An aggregate, so a turn rated a million times
    costs one row per task."""
    order = F.struct("created_at", "id")

    def newest(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)

    return ratings.where(F.col("rating").isin("up", "down")).groupBy("turn_id").agg(
        newest("rating"), newest("category"), newest("comment"), F.count(F.lit(1)).alias("times"))


def signals(o: Column, entities: Column, slow_ms: float = ref.SLOW_MS) -> Column:
    """DP20: what went wrong in a turn, most specific first; ['no_signal'] when
    nothing shows. `o` is the outcome struct, NULL when none was recorded;
    `entities` the resolved vehicle id."""
    def items(name):
        return F.coalesce(o[name], F.array().cast("array<string>"))

    def statuses(tool):
        mine = F.filter(items("evidence_statuses"), lambda s: F.split_part(s, F.lit(":"), F.lit(1)) == tool)
        return F.transform(mine, lambda s: F.regexp_replace(s, "^[^:]*:?", ""))

    errors, tools = items("node_errors"), items("tools_selected")
    sql, rag = statuses("structured_query_tool"), statuses("rag_retrieval_tool")
    rules = {
        "wrong_domain": F.exists(errors, lambda e: e.startswith("router"))
        | (F.coalesce(entities != "", F.lit(False)) & (items("domains") == F.array(F.lit("business")))),
        "wrong_tool": (o.isNotNull() & (F.size(tools) == 0)) | (o["query_type"].eqNullSafe("lookup") & ~F.array_contains(tools, "structured_query_tool")),
        "step_failed": F.exists(errors, lambda e: ~e.startswith("router")),
        "sql_failed": (F.size(sql) > 0) & F.forall(sql, lambda s: s == "failed"),
        "empty_retrieval": (F.size(rag) > 0) & ~F.exists(rag, lambda s: s == "ok"),
        "grounding_failure": o["grounded"].eqNullSafe(False),
        "hit_limit": F.coalesce(o["stop_reason"].isin("cap_reached", "timeout"), F.lit(False)),
    }
    hits = F.filter(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]), lambda x: x.isNotNull())
    slow = F.coalesce(o["latency_ms"] > slow_ms, F.lit(False))
    return F.when(F.size(hits) > 0, hits).when(slow, F.array(F.lit("slow"))).otherwise(F.array(F.lit("no_signal")))


def with_signature(turns: DataFrame, slow_ms: float = ref.SLOW_MS) -> DataFrame:
    """DP20: turns (outcome as JSON, vehicle_id) with their signals and cluster."""
    # One-element arrays keep Spark from copying the long expressions into
    # every place that reads them.
    parsed = turns.withColumn("_o", F.explode(F.array(F.from_json("outcome", OUTCOME))))
    signed = parsed.withColumn("signals", F.explode(F.array(signals(F.col("_o"), F.col("vehicle_id"), slow_ms))))
    return signed.withColumn("cluster", F.element_at("signals", 1)).drop("_o")


def signatures(turns: DataFrame) -> DataFrame:
    """DP20: turn_id, cluster and signals of every turn, written once for all that reads them."""
    return session.cut(with_signature(turns).select("turn_id", "cluster", "signals"), "signatures")


def flagged_turns(flags: DataFrame, turns: DataFrame) -> DataFrame:
    """Negative flags with the cluster of their turn. turns: stored turns, or their signatures()."""
    signed = turns if "signals" in turns.columns else with_signature(turns)
    return flags.where(F.col("rating").isin(NEGATIVE)).join(signed.select("turn_id", "cluster", "signals"), "turn_id")


def cluster_rank(cluster) -> Column:
    at = F.array_position(F.array(*[F.lit(c) for c in ref.CLUSTER_ORDER]), cluster)
    return F.when(at == 0, 99).otherwise(at)


def queue(items: DataFrame) -> DataFrame:
    """TK7: open items, one per turn, biggest cluster first. The first flag of a
    turn stands for it; cluster sizes are a few rows."""
    keep = F.min_by(F.struct("id", "rating"), F.struct("created_at", "id"))
    open_ = items.where("review_status = 'new'").groupBy("cluster", "turn_id").agg(keep.alias("f"))
    sizes = open_.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return open_.join(F.broadcast(sizes), "cluster").select("cluster", "cluster_size", "turn_id", F.col("f.id").alias("flag_id"), F.col("f.rating").alias("rating")).orderBy(
        F.desc("cluster_size"), cluster_rank(F.col("cluster")), "turn_id")


def cluster_status(items: DataFrame, promoted: DataFrame, results: DataFrame) -> DataFrame:
    """AG26: per cluster its flags, the cases that guard it, and its state.
    promoted: id, cluster, promoted_on; results: id, pass."""
    last = promoted.groupBy("cluster").agg(F.max("promoted_on").alias("_last"))
    flags = items.join(F.broadcast(last), "cluster", "left").groupBy("cluster").agg(
        F.count_distinct("turn_id").alias("flags"), F.count(F.when(F.col("review_status") == "new", 1)).alias("open"),
        F.count(F.when(F.col("review_status") == "dismissed", 1)).alias("dismissed"),
        F.count(F.when(F.to_date("created_at") > F.col("_last"), 1)).alias("new_since"))
    cases = promoted.join(results.select("id", "pass"), "id", "left").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("pass"), 1)).alias("passing"),
        F.count(F.when(~F.col("pass"), 1)).alias("failing"))
    both = flags.join(cases, "cluster", "full_outer").na.fill(0)
    all_pass = (F.col("cases") > 0) & (F.col("passing") == F.col("cases"))
    state = (F.when(all_pass & (F.col("new_since") == 0), "resolved").when(all_pass, "recurring")
             .when(F.col("failing") > 0, "fix in progress").when(F.col("cases") > 0, "awaiting eval run")
             .when(F.col("open") > 0, "unreviewed").otherwise("dismissed only"))
    return both.withColumn("not_yet_run", F.col("cases") - F.col("passing") - F.col("failing")).withColumn("state", state)


def coverage_warnings(drafts: DataFrame, existing: DataFrame, max_cases: int = ref.MAX_CASES_PER_CLUSTER) -> DataFrame:
    """DP21: drafts whose cluster has enough cases already."""
    counts = existing.groupBy("cluster").agg(F.count(F.lit(1)).alias("existing_cases")).where(F.col("existing_cases") >= max_cases)
    return drafts.join(F.broadcast(counts), "cluster").select("id", "cluster", "existing_cases")


def is_failure() -> Column:
    """PF19: a run worth keeping: outcome columns of one turn."""
    return (
        (F.size(F.coalesce("node_errors", F.array().cast("array<string>"))) > 0) | F.col("error").isNotNull()
        | F.col("grounded").eqNullSafe(False) | F.coalesce("partial", F.lit(False))
        | F.coalesce(F.col("stop_reason").isin(ref.FAILURE_STOP_REASONS), F.lit(False)))


def eligible(min_chars: int = 40) -> Column:
    """PF18: complete, long enough and with evidence."""
    return ~F.coalesce("partial", F.lit(False)) & (F.length("answer") >= min_chars) & (F.col("evidence_count") > 0)


def capped_evidence(evidence: DataFrame, cap: int) -> DataFrame:
    """TK6: at most `cap` entries per answer, misses before hits, newest first.
    evidence: answer_id, evidence_no, status."""
    return skew.top_per_key(
        evidence, ["answer_id"], [F.when(F.col("status") == "ok", 1).otherwise(0), F.desc("evidence_no")], cap, "kept_rank")
