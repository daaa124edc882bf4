"""Whether written answers rest on their evidence.

answers:  answer_id, question, answer, partial, stop_reason
evidence: answer_id, evidence_id, status, trust_level, source_doc, verdict,
          quality_warning, summary, actual, baseline, delta_pct, rerank_score"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens.functions import text


def supports_cause() -> Column:
    """DP27: evidence that may carry a 'because'."""
    return (
        (F.col("status") == "ok") & ~F.col("trust_level").eqNullSafe("external") & F.col("quality_warning").isNull()
        & (F.col("source_doc").isNotNull() | F.col("verdict").isNotNull()))


def _tags(s) -> Column:
    return F.regexp_extract_all(s, F.lit(text.TAG), 1)


def citations(answers: DataFrame) -> DataFrame:
    """DP22: one row per different (claim, evidence) pair of an answer; the claim
    is the sentence without its tags. Row by row, no shuffle."""
    def cited(sentence):
        claim = text.squash(F.regexp_replace(sentence, text.TAG, ""))
        return F.transform(_tags(sentence), lambda e: F.struct(
            F.when(claim == "", sentence).otherwise(claim).alias("claim"), e.alias("evidence_id")))

    pairs = F.array_distinct(F.flatten(F.transform(text.sentences(F.col("answer")), cited)))
    return answers.select("answer_id", F.inline(pairs))


def unresolved(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """DP24: cited ids that no evidence has."""
    tags = answers.select("answer_id", F.explode(F.array_distinct(_tags(F.col("answer")))).alias("evidence_id"))
    return tags.join(evidence, ["answer_id", "evidence_id"], "left_anti")


def confidence(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """DP23: high, medium or low, from how the answer ended and what it cites."""
    usable = evidence.where("status = 'ok'").select("answer_id", "evidence_id")
    cited = citations(answers).select("answer_id", "evidence_id").distinct().join(usable, ["answer_id", "evidence_id"], "left_semi")
    n = cited.groupBy("answer_id").agg(F.count(F.lit(1)).alias("_n"))
    level = (F.when(F.col("partial") | F.col("_n").isNull(), "low")
             .when((F.col("stop_reason") == "complete") & (F.col("_n") >= 2), "high").otherwise("medium"))
    return answers.join(n, "answer_id", "left").select("answer_id", level.alias("confidence"))


def claimed_numbers(answers: DataFrame) -> DataFrame:
    """SF27: (answer_id, sentence_no, tags, raw, value), small whole numbers left out."""
    rows = answers.select("answer_id", F.posexplode(text.sentences(F.col("answer"))).alias("sentence_no", "sentence"))
    rows = rows.select("answer_id", "sentence_no", _tags(F.col("sentence")).alias("tags"), F.explode(text.numbers(F.col("sentence"))).alias("raw"))
    value = text.as_number(F.col("raw"))
    small = (F.col("value") == F.floor("value")) & (F.abs("value") < ref.IGNORE_INTEGERS_BELOW)
    return rows.withColumn("value", value).where(F.col("value").isNotNull() & ~small)


def evidence_numbers(evidence: DataFrame) -> DataFrame:
    """(answer_id, evidence_id, p): every number an evidence entry holds, without sign."""
    told = F.transform(text.numbers(F.col("summary")), text.as_number)
    fields = F.array(*[F.col(c).cast("double") for c in ("actual", "baseline", "delta_pct", "rerank_score")])
    every = F.array_distinct(F.transform(F.filter(F.concat(told, fields), lambda x: x.isNotNull()), lambda x: F.abs(x)))
    return evidence.select("answer_id", "evidence_id", F.explode(every).alias("p"))


def untraceable(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """DP25/J21: numbers that match no evidence. A sentence that cites entries is
    checked against these, any other against all entries of its answer; numbers
    of the question always count."""
    numbers = claimed_numbers(answers)
    pool = evidence_numbers(evidence)
    key = ["answer_id", "sentence_no", "raw"]
    ok = text.traces(F.col("raw"), F.abs("value"), F.col("p"), ref.NUMERIC_TOLERANCE_PCT)

    cited = numbers.withColumn("evidence_id", F.explode(F.array_distinct("tags"))).join(
        evidence.select("answer_id", "evidence_id"), ["answer_id", "evidence_id"])
    free = numbers.join(cited.select(*key).distinct(), key, "left_anti")
    by_tag = cited.join(pool, ["answer_id", "evidence_id"]).where(ok)
    by_answer = free.join(pool.select("answer_id", "p").distinct(), "answer_id").where(ok)
    asked = answers.select("answer_id", F.explode(F.transform(text.numbers(F.col("question")), lambda x: F.abs(text.as_number(x)))).alias("p"))
    by_question = numbers.join(asked, "answer_id").where(ok)
    traced = reduce(DataFrame.union, [x.select(*key) for x in (by_tag, by_answer, by_question)])
    return numbers.join(traced, key, "left_anti").select("answer_id", "raw").distinct()


def _words(s) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), 1))


def unsupported_causes(answers: DataFrame, evidence: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """DP26: sentences that state a cause without evidence that may carry one. A
    clause that admits a gap is no claim. Citations count for a sentence that
    tags them or repeats 60 % of their claim's words."""
    s = answers.select("answer_id", F.posexplode(text.sentences(F.col("answer"))).alias("sentence_no", "sentence"))
    causal = F.filter(text.clauses(F.col("sentence")), lambda c: text.any_marker(c, ref.CAUSAL_MARKERS))
    s = s.where(text.any_marker(F.col("sentence"), ref.CAUSAL_MARKERS)).where(
        ~F.forall(causal, lambda c: text.any_marker(c, ref.CAUSAL_EXEMPT)))
    claims = citations(answers) if claims is None else claims
    tagged = s.select("answer_id", "sentence_no", F.explode(_tags(F.col("sentence"))).alias("evidence_id"))
    said, held = _words(F.col("claim")), _words(F.col("sentence"))
    reworded = s.join(claims, "answer_id").where(
        (F.size(said) > 0) & (F.try_divide(F.size(F.array_intersect(said, held)), F.size(said)) >= 0.6))
    backed = tagged.union(reworded.select("answer_id", "sentence_no", "evidence_id")).join(
        evidence.where(supports_cause()), ["answer_id", "evidence_id"], "left_semi")
    return s.join(backed, ["answer_id", "sentence_no"], "left_anti").select("answer_id", "sentence")


def _check(name: str, asked: Column, passed: Column) -> Column:
    return F.when(asked, F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed")))


def says_it_cannot_tell(answer, partial) -> Column:
    return partial | text.contains_any(answer, F.array(*[F.lit(m) for m in ref.ABSTAIN_MARKERS]))


def run_checks(results: DataFrame) -> DataFrame:
    """DP28: adds checks, an array of (name, passed) with only what the case
    asks for, and code_pass. Outcome columns: answer, domains, vehicle_id, calls
    (array of tool, args), iterations, stop_reason, partial, grounded, cited,
    evidence_ids. What a case expects is the struct `expected`; a NULL or empty
    field asks for nothing."""
    e, answer = F.col("expected"), F.col("answer")
    used = F.transform("calls", lambda c: c["tool"])

    def some(field):
        return F.coalesce(F.size(e[field]) > 0, F.lit(False))

    def call_has(spec, call):
        args = text.fold(call["args"])
        fits = spec["tool"].isNull() | (call["tool"] == spec["tool"])
        return fits & F.forall(spec["contains"], lambda w: F.contains(args, text.fold(w)))

    told = F.transform(text.numbers(answer), lambda x: F.abs(text.as_number(x)))
    checks = F.array(
        _check("domains", e["domains"].isNotNull(), F.array_sort(F.array_distinct("domains")) == F.array_sort(F.array_distinct(e["domains"]))),
        _check("entity", e["vehicle_id"].isNotNull(), F.when(e["vehicle_id"] == "not_found", F.col("vehicle_id").isNull()).otherwise(
            F.col("vehicle_id").eqNullSafe(e["vehicle_id"]))),
        _check("tools", some("tools"), F.size(F.array_except(e["tools"], used)) == 0),
        _check("key_args", some("key_args"), F.forall(e["key_args"], lambda k: F.exists("calls", lambda c: call_has(k, c)))),
        _check("forbidden_args", some("forbidden_args"), ~F.exists(e["forbidden_args"], lambda k: F.exists("calls", lambda c: call_has(k, c)))),
        _check("iterations", e["max_iterations"].isNotNull(), F.col("iterations") <= e["max_iterations"]),
        _check("stop_reason", some("stop_reasons"), F.array_contains(e["stop_reasons"], F.col("stop_reason"))),
        _check("facts", some("facts"), F.forall(e["facts"], lambda f: F.exists(told, lambda n: F.abs(n - F.abs(f["value"])) <= f["tolerance"]))),
        _check("must_contain", some("must_contain"), F.forall(e["must_contain"], lambda any_of: text.contains_any(answer, any_of))),
        _check("must_not_contain", some("must_not_contain"), ~text.contains_any(answer, e["must_not_contain"])),
        _check("abstain", F.coalesce(e["abstain"], F.lit(False)), says_it_cannot_tell(answer, F.col("partial"))),
        _check("grounded", F.coalesce(e["grounded"], F.lit(False)), F.col("grounded").eqNullSafe(True)),
        _check("citations", F.lit(True), F.size(F.array_except("cited", "evidence_ids")) == 0))
    return results.withColumn("checks", F.filter(checks, lambda c: c.isNotNull())).withColumn(
        "code_pass", F.forall("checks", lambda c: c["passed"]))


EXPECTED = """struct<domains:array<string>,vehicle_id:string,tools:array<string>,
    key_args:array<struct<tool:string,contains:array<string>>>,forbidden_args:array<struct<tool:string,contains:array<string>>>,
    max_iterations:int,stop_reasons:array<string>,facts:array<struct<label:string,value:double,tolerance:double>>,
    must_contain:array<array<string>>,must_not_contain:array<string>,abstain:boolean,grounded:boolean>"""


def score_traps(results: DataFrame) -> DataFrame:
    """DP29: whether a trap question was declined, and whether a known answer slipped out."""
    return results.withColumn("abstained", says_it_cannot_tell(F.col("answer"), F.col("partial"))).withColumn(
        "ungrounded_truth", text.contains_any(F.col("answer"), F.col("known_answer")))


def sanitised(cases: DataFrame) -> DataFrame:
    """DP32: expectations a right answer can meet. Numbers inside phrases become
    facts; zeros, numbers of the question and repeats go; phrases keep at most
    two words, the first three stay. cases: id, question, must_contain, facts
    (array of double)."""
    number = r"(\d[\d,]*(?:\.\d+)?)"

    def found(s):
        return F.transform(F.regexp_extract_all(s, F.lit(number), 1), text.as_number)

    phrases = F.filter(F.transform("must_contain", text.strip), lambda p: (p != "") & ~p.rlike(r"\d") & (F.size(F.split(text.squash(p), " ")) <= 2))
    told = F.flatten(F.transform("must_contain", found))
    asked = found(F.col("question"))
    values = F.filter(F.array_distinct(F.concat(told, "facts")), lambda v: (v != 0) & ~F.array_contains(asked, v))
    return cases.withColumns({"must_contain": F.slice(phrases, 1, 3), "facts": values})


def apply_overrides(cases: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """DP33: reviewed corrections by id; a field the override leaves NULL keeps its value."""
    o = overrides.select("id", "reason", *[F.col(f).alias(f"_o_{f}") for f in fields])
    joined = cases.join(o, "id", "left")
    return joined.select(
        *[F.coalesce(f"_o_{c}", c).alias(c) if c in fields else F.col(c) for c in cases.columns], F.col("reason").alias("override"))


def stale_overrides(cases: DataFrame, overrides: DataFrame) -> DataFrame:
    """DP33: overrides whose case is gone."""
    return overrides.join(cases, "id", "left_anti").select("id", "reason")


def fill_facts(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """DP34: numbers computed from data put into reference answers. cases: id,
    label, reference_answer with {label}; facts: label, value."""
    shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.round("value", 2).cast("string"))
    return cases.join(facts, "label", "left").withColumn(
        "reference_answer", F.replace(text.squash("reference_answer"), F.concat(F.lit("{"), "label", F.lit("}")), F.coalesce(shown, F.lit("None"))))


def audit_cases(cases: DataFrame) -> DataFrame:
    """DP36: how many cases break each rule, in one pass and one count per id."""
    ids = cases.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n"))
    rules = {"empty_question": F.trim(F.coalesce("question", F.lit(""))) == "",
             "empty_reference": F.trim(F.coalesce("reference_answer", F.lit(""))) == "",
             "fact_without_value": F.exists("facts", lambda f: f.isNull())}
    counts = cases.agg(*[F.count(F.when(r, 1)).alias(n) for n, r in rules.items()])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("cases")) for n in rules])))
    return rows.unionByName(ids.select(F.lit("duplicate_id").alias("rule"), F.col("n").alias("cases")))
