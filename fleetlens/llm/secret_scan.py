"""Secrets in texts: three fixed patterns, and strings that a character Markov model takes for random.

Column functions only: no Python runs on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: What the base patterns match, in the order in which kinds are listed. The last group is the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Characters of the models; a candidate is a run of so many of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
SEGMENT = "[A-Za-z0-9+]{20,}"
#: Characters of a candidate and of a stretch of one, and of what a base finding leaves of a candidate.
LEAST, LEFT = 20, 8
IDENTIFIER = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,19}(?![A-Za-z0-9+/_=-])"
#: Ordinary identifiers are learnt from about so many documents, taken by a hash of the text.
ORDINARY_DOCS = 2_000
#: Share of the random model that is uniform, pseudo-count of a transition, and the mean log-likelihood ratio of a finding.
UNIFORM, SMOOTH, LEAST_RATIO = 0.5, 0.1, 1.0


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _located(text: Column, matches: Column, pattern: str, kind: str) -> Column:
    """Each match with its kind and place in code points: what stands between the matches is what a split leaves."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    struct = lambda start, value: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    walked = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.greatest(F.size(matches), F.lit(1))).alias("gap"), matches.alias("value")),
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda s, m: F.struct((s["at"] + m["gap"] + F.length(m["value"])).alias("at"), F.concat(s["found"], F.array(struct(s["at"] + m["gap"], m["value"]))).alias("found")),
        lambda s: s["found"])
    return F.when(F.size(matches) > 0, walked).otherwise(empty)


def with_base(rows: DataFrame, text: str = "_text") -> DataFrame:
    """Adds _assign, _access and _hex: the base findings with their places."""
    whole = F.col(text)
    rows = rows.withColumns({"_assign_m": _matches(whole, ASSIGN), "_access_m": _matches(whole, ACCESS), "_hex_m": _matches(whole, HEX)})
    rows = rows.withColumns({
        "_assign": _located(whole, F.col("_assign_m"), ASSIGN, "assign"), "_access": _located(whole, F.col("_access_m"), ACCESS, "access"), "_hex": _located(whole, F.col("_hex_m"), HEX, "hex")})
    # A match with a short value is taken first and dropped then, as it hides what it covers.
    long_enough = F.filter("_assign", lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= ASSIGN_VALUE)
    return rows.withColumn("_assign", long_enough).drop("_assign_m", "_access_m", "_hex_m")


def _transitions(values: DataFrame, weight: Column) -> dict[tuple[int, int], float]:
    """How often each character of the alphabet follows each other one, in the column `value`. A fixed number of counts."""
    pairs = values.where(F.length("value") > 1).select(weight.alias("w"), F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum("w").alias("n")).collect()
    return {(ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])): float(r["n"]) for r in counts if len(r["pair"]) == 2 and all(c in ALPHABET for c in r["pair"])}


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratios of all transitions, random over ordinary.

    The samples label themselves: the values that the base patterns find in all documents are random strings, and the distinct runs of
    word characters too short to be candidates, in a bounded number of documents, as they are and in capitals, are ordinary identifiers. Both are counted by grouped
    aggregates. Half of the random model is uniform, so that alphabets that the corpus's secrets don't use count as random as well."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = with_base(texts).select(F.concat(
        F.transform("_assign", lambda m: F.regexp_extract(m["value"], ASSIGN, 1)), F.transform("_access", lambda m: m["value"]), F.transform("_hex", lambda m: m["value"])).alias("values"))
    random = _transitions(found.where(F.size("values") > 0).select(F.explode("values").alias("value")), F.lit(1))
    n = texts.count()
    some = texts.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, ORDINARY_DOCS / max(n, 1)))))
    long_ = "=" * LEAST  # what stands beside a finding is not learnt as ordinary
    without = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", ASSIGN, long_), ACCESS, long_), HEX, long_)
    words = some.select(F.explode(_matches(without, IDENTIFIER)).alias("value")).distinct()
    ordinary = _transitions(words.select(F.explode(F.array("value", F.upper("value"))).alias("value")), F.lit(1))
    size = len(ALPHABET)
    ratios = []
    for a in range(size):
        of_random, of_ordinary = sum(random.get((a, b), 0) for b in range(size)), sum(ordinary.get((a, b), 0) for b in range(size))
        for b in range(size):
            learnt = (random.get((a, b), 0) + SMOOTH) / (of_random + SMOOTH * size)
            usual = (ordinary.get((a, b), 0) + SMOOTH) / (of_ordinary + SMOOTH * size)
            ratios.append(math.log((1 - UNIFORM) * learnt + UNIFORM / size) - math.log(usual))
    return ratios


def mean_ratio(value: Column, ratios: list[float]) -> Column:
    """The mean log-likelihood ratio of a string's transitions."""
    numbers = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))))
    table = F.lit([float(r) for r in ratios])
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    walked = F.aggregate(
        numbers, start,
        lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when((s["last"] > 0) & (c > 0), F.get(table, (s["last"] - 1) * len(ALPHABET) + c - 1)).otherwise(0.0)).alias("sum")),
        lambda s: s["sum"])
    return walked / F.greatest(F.length(value) - 1, F.lit(1))


def _left(found: Column, base: str) -> Column:
    """The parts of a candidate that no base finding covers."""
    part = lambda a, b: F.struct(a.alias("start"), found["kind"].alias("kind"), b.alias("end"), F.substring(found["value"], a - found["start"] + 1, b - a).alias("value"))
    touching = F.filter(base, lambda b: (b["start"] < found["end"]) & (found["start"] < b["end"]))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    walked = F.aggregate(
        touching, F.struct(found["start"].alias("at"), empty.alias("parts")),
        lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.concat(s["parts"], F.array(part(s["at"], b["start"]))).alias("parts")),
        lambda s: F.concat(s["parts"], F.array(part(s["at"], found["end"]))))
    return F.when(F.size(touching) > 0, F.filter(walked, lambda p: p["end"] - p["start"] >= LEFT)).otherwise(F.array(found))


def _stretches(value: Column, ratios: list[float]) -> Column:
    """start and end of the random parts of a string that is not random as a whole, apart and in order: segments between / _ - = by their
    mean, and the stretches over which a running sum of what each transition has above the least ratio rises. Of 20 characters or more."""
    numbers = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))))
    table = F.lit([float(r) for r in ratios])
    empty = F.array().cast("array<struct<start:int,end:int>>")
    closed = lambda s: F.when(s["end"] - s["start"] >= LEAST, F.concat(s["found"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["found"])

    def step(s: Column, c: Column) -> Column:
        total = s["sum"] + F.when(s["last"] > 0, F.get(table, (s["last"] - 1) * len(ALPHABET) + c - 1) - LEAST_RATIO).otherwise(0.0)
        over, higher = total <= 0, total > s["best"]
        return F.struct(
            (s["at"] + 1).alias("at"), c.alias("last"), F.when(over, 0.0).otherwise(total).alias("sum"), F.when(over, 0.0).otherwise(F.greatest(total, s["best"])).alias("best"),
            F.when(over, s["at"]).otherwise(s["start"]).alias("start"), F.when(over | higher, s["at"] + 1).otherwise(s["end"]).alias("end"), F.when(over, closed(s)).otherwise(s["found"]).alias("found"))

    nothing = F.struct(*[F.lit(0).alias(n) for n in ("at", "last")], *[F.lit(0.0).alias(n) for n in ("sum", "best")], *[F.lit(0).alias(n) for n in ("start", "end")], empty.alias("found"))
    stretches = F.aggregate(numbers, nothing, step, closed)
    segments = F.filter(_located(value, _matches(value, SEGMENT), SEGMENT, "markov"), lambda m: mean_ratio(m["value"], ratios) >= LEAST_RATIO)
    both = F.array_sort(F.concat(stretches, F.transform(segments, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))))
    span = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
    merged = F.aggregate(
        both, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), empty.alias("found")),
        lambda s, m: F.struct(
            F.when(m["start"] <= s["end"], s["start"]).otherwise(m["start"]).alias("start"), F.greatest(s["end"], m["end"]).alias("end"),
            F.when((m["start"] <= s["end"]) | (s["end"] < 0), s["found"]).otherwise(F.concat(s["found"], span(s))).alias("found")),
        lambda s: F.when(s["end"] < 0, s["found"]).otherwise(F.concat(s["found"], span(s))))
    return merged


def _random(found: Column, whole: Column, ratios: list[float]) -> Column:
    """The random parts of what is left of a candidate: all of it, or stretches. What is too short for stretches has to be rather random
    than ordinary if the whole candidate is random."""
    parts = F.transform(_stretches(found["value"], ratios), lambda m: F.struct(
        (found["start"] + m["start"]).alias("start"), found["kind"].alias("kind"), (found["start"] + m["end"]).alias("end"), F.substring(found["value"], m["start"] + 1, m["end"] - m["start"]).alias("value")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    least = F.when((F.length(found["value"]) < LEAST) & (mean_ratio(whole["value"], ratios) >= LEAST_RATIO), 0.0).otherwise(LEAST_RATIO)
    return F.when(mean_ratio(found["value"], ratios) >= least, F.array(found)).when(F.length(found["value"]) >= LEAST, parts).otherwise(none)


def with_spans(rows: DataFrame, ratios: list[float], text: str = "_text") -> DataFrame:
    """Adds the base columns and _markov, and _spans: all findings by start, then kind."""
    rows = with_base(rows, text).withColumn("_candidates", _matches(F.col(text), CANDIDATE))
    rows = rows.withColumn("_markov", _located(F.col(text), F.col("_candidates"), CANDIDATE, "markov")).drop("_candidates")
    rows = rows.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    rows = rows.withColumn("_markov", F.flatten(F.transform("_markov", lambda m: F.flatten(F.transform(_left(m, "_base"), lambda p: _random(p, m, ratios))))))
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", "_markov")))


def _listed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_markov of every whole text.

    Base findings are the fixed patterns', leftmost and not overlapping within a kind; the models add runs of 20 or more word characters,
    and parts of 8 or more that base findings leave of such runs, whose mean log-likelihood ratio is 1 or more (0 for a part under 20 of a run that has 1); else the segments and stretches of 20 or more
    in them that reach it. Places are code points, the end exclusive; findings are listed by start,
    then kind. No text is shuffled; training shuffles transition counts only.

    A null or empty text has no finding (n 0, the digest of nothing, no spans). Long texts are read whole. Null keys stay null, repeated rows give
    repeated results, other columns are not read, an empty table gives an empty result."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    found = with_spans(rows, train(docs))
    return found.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_spans").alias("spans"), F.size("_markov").cast("long").alias("n_markov"))


def redacted(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The documents with each finding (overlapping ones together) replaced by `mark`; n_chars, if there is one, follows. A text without findings stays as
    it is, null included; all other columns pass through."""
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = with_spans(rows, train(docs)).select("_doc", "_text", "_spans")
    walked = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, m: F.struct(
            F.greatest(s["at"], m["end"]).alias("at"),
            F.when(m["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, m["start"] - s["at"]), F.lit(mark))).alias("out")),
        lambda s: F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, F.length("_text") - s["at"])))
    rows = rows.withColumn("_new", F.when(F.size("_spans") > 0, walked).otherwise(F.col("_doc.text")))
    columns = []
    for c in own:
        if c == "text":
            columns.append(F.col("_new").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.size("_spans") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"_doc.`{c}`").alias(c))
    return rows.select(*columns)
