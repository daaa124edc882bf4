import datetime as dt
import itertools
import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens import reference as ref
from fleetlens.functions import fuzzy
from fleetlens.operators import audit, diagnose, documents, evaluation, feedback, matching, opsmetrics, quality, rollup, search, skew
from fleetlens.sources import files, tables, upsert


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows under one key, with ties and NULL keys."""
    return spark.range(2000).select(
        "id", F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 7).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(150))).alias("at"), (F.col("id") % 11).alias("v")).cache()


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot_rows", [100, 10_000_000])
def test_running_equals_window(skewed, hot_rows):
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("id", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    got = skew.running(skewed, ["k"], F.col("at"), ["id"], {"s": F.col("v"), "n": F.lit(1)}, hot_rows)
    assert rows(got, "id", "s", "n") == rows(want, "id", "s", "n")


@pytest.mark.parametrize("hot_rows", [100, 10_000_000])
@pytest.mark.parametrize("following", [False, True])
def test_neighbour_equals_lag_and_lead(skewed, hot_rows, following):
    w = Window.partitionBy("k").orderBy("at", "id")
    f = F.lead if following else F.lag
    want = skewed.select("id", f("v").over(w).alias("p"))
    got = skew.neighbour(skewed, ["k"], F.col("at"), ["id"], {"p": F.col("v")}, following, hot_rows)
    assert rows(got, "id", "p") == rows(want, "id", "p")


def test_running_without_keys(skewed):
    got = skew.running(skewed.select("id"), [], F.col("id"), [], {"n": F.lit(1)}, 100)
    assert rows(got, "id", "n") == sorted(((i, i + 1) for i in range(2000)), key=str)


@pytest.mark.parametrize("hot_rows", [50, 10_000_000])
def test_percentiles(skewed, hot_rows):
    got = skew.percentiles(skewed, ["k"], "at", {"m": ("cont", 0.5), "d": ("disc", 0.9)}, hot_rows)
    want = skewed.groupBy("k").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY at)").alias("m"),
                                   F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY at)").alias("d"))
    assert rows(got, "k", "m", "d") == rows(want, "k", "m", "d")


def test_streaks_and_rolling_sum(skewed):
    ts = skewed.withColumn("ts", F.timestamp_seconds(F.col("at") * 7))
    got = opsmetrics.rolling_sum(ts, ["k"], "ts", "v", 60, 120)
    w = Window.partitionBy("k").orderBy(F.col("at") * 7).rangeBetween(-59, 0)
    assert rows(got, "id", "used") == rows(skewed.select("id", F.sum("v").over(w).alias("used")), "id", "used")
    runs = [opsmetrics.streaks(ts, ["k"], F.col("at"), ["id"], F.col("v") > 4, 3, "ts", h) for h in (100, 10_000_000)]
    assert rows(runs[0], "k", "length", "started") == rows(runs[1], "k", "length", "started")


def test_rollup_refresh_equals_full(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, i % 3, t0 + dt.timedelta(minutes=13 * i), "m", float(i % 17), None if i % 4 == 0 else "Eco") for i in range(400)]
    df = spark.createDataFrame(data, "id long, vehicle_id long, recorded_at timestamp, metric_name string, metric_value double, drive_mode string")
    late = df.where("id % 19 = 0")
    out = rollup.refresh_touched(rollup.hourly(df.where("id % 19 <> 0")), df, late)
    cols = [*rollup.KEYS, "readings", "sum_value"]
    assert rows(out, *cols) == rows(rollup.hourly(df), *cols)


def test_guard_keeps_unmatched_rows(spark):
    r = spark.createDataFrame([(1, "a", 5.0, None), (1, "a", 999.0, "above_physical_range")], "vehicle_id long, metric_name string, metric_value double, quality_flag string")
    v = spark.createDataFrame([(1,), (2,)], "vehicle_id long")
    assert v.join(quality.clean_readings(r), "vehicle_id", "left").count() == 2
    assert quality.clean_readings(r, include_faults=True).count() == 2


def test_decline(spark):
    data = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * w), 92 - 0.6 * w) for w in range(9)]
    df = spark.createDataFrame(data, "vehicle_id long, recorded_at timestamp, metric_value double")
    assert diagnose.decline(df, ["vehicle_id"]).first()["per_day"] * 7 == pytest.approx(-0.6)


# search

HIT = "query_id long, chunk_id long, score double, rank int"


def ranked(spark, ids):
    return spark.createDataFrame([(1, c, 0.0, r) for r, c in enumerate(ids, 1)], HIT)


def test_fusion(spark):
    out = search.fuse(ranked(spark, [1, 2, 3]), ranked(spark, [4, 2, 5])).orderBy(F.desc("hybrid_score")).collect()
    assert out[0]["chunk_id"] == 2 and {r["chunk_id"] for r in out} == {1, 2, 3, 4, 5}
    assert out[0]["hybrid_score"] == pytest.approx(0.6 / 62 + 0.4 / 62)


def candidates(spark, scores, boosts=None):
    data = [(1, c, s, (boosts or {}).get(c, 0.0), f"text {c}", "q", i) for i, (c, s) in enumerate(scores, 1)]
    return spark.createDataFrame(data, "query_id long, chunk_id long, hybrid_score double, boost double, content string, query string, position int")


@pytest.mark.parametrize("scores,skip", [([0.02, 0.01], True), ([0.02, 0.019], False), ([0.5], True), ([0.0, 0.0], False), ([0.02, 0.015], True)])
def test_decisive_leader(spark, scores, skip):
    assert search.decisive(candidates(spark, list(enumerate(scores)))).first()["rerank_skipped"] == skip


def test_rerank_boost_reorders_only(spark):
    c = candidates(spark, [(1, 0.02), (2, 0.0199)], {2: 0.15})
    out = search.rerank(c, lambda q, x: F.when(x == "text 1", 0.80).otherwise(0.75)).orderBy("final_rank").collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in out] == [(2, 0.75), (1, 0.8)]


def test_threshold_status(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    r = spark.createDataFrame([(1, 0.55), (1, 0.2), (2, 0.54)], "query_id long, rerank_score double")
    got = {x["query_id"]: (x["status"], x["best_score"], x["kept"]) for x in search.with_status(q, r, 0.55).collect()}
    assert got == {1: ("ok", 0.55, 1), 2: ("below_threshold", 0.54, 0), 3: ("empty", None, 0)}


def test_dense_ways_agree(spark):
    r = random.Random(3)
    make = lambda n: [(i, "ab"[i % 2], [r.random() for _ in range(8)]) for i in range(n)]
    chunk_rows = make(120)
    chunk_rows += [(200 + i, "a", chunk_rows[0][2]) for i in range(60)]       # a group of copies
    q = spark.createDataFrame(make(30), "query_id long, domain string, embedding array<float>")
    c = spark.createDataFrame(chunk_rows, "chunk_id long, domain string, embedding array<float>")
    one = search.dense_top_k(q, c, 4)
    many = search.dense_top_k(q, c, 4, max_queries=10, cell_rows=25)
    cols = ("query_id", "chunk_id", "score", "rank")
    assert rows(one, *cols) == rows(many, *cols) and one.count() == 120


# matching

def resolve(spark, raws, known):
    out = matching.resolve(spark.createDataFrame([(r,) for r in raws], "raw string"), spark.createDataFrame([(k,) for k in known], "known string"))
    return {r["raw"]: r for r in out.collect()}


def test_resolution_dense_fleet(spark):
    got = resolve(spark, ["1042", "vin 1042", "VIN-104", "TRUCK-99", "  "], [f"VIN-{i}" for i in range(1001, 1301)])
    assert got["1042"]["value"] == got["vin 1042"]["value"] == "VIN-1042" and got["1042"]["status"] == "exact"
    assert got["VIN-104"]["status"] == "ambiguous" and len(got["VIN-104"]["suggestions"]) == 3
    assert got["TRUCK-99"]["status"] == got["  "]["status"] == "not_found"


def plain_bm25(queries, chunks, k):
    """(query, chunk) -> rank and score, word by word."""
    out = {}
    for q, domain, words in queries:
        own = [(c, re.findall(r"[^\W_]+", (t or "").lower())) for c, d, t in chunks if d == domain and t is not None]
        mean = sum(len(w) for _, w in own) / max(len(own), 1)
        scores = {}
        for w in set(re.findall(r"[^\W_]+", words.lower())) - set(ref.ENGLISH_STOP_WORDS):
            df = sum(w in ws for _, ws in own)
            for c, ws in own:
                if w in ws:
                    tf = ws.count(w)
                    scores[c] = scores.get(c, 0) + math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        for rank, (score, c) in enumerate(sorted((-round(s, 6), c) for c, s in scores.items())[:k], 1):
            out[q, c] = rank, round(-score, 6)
    return out


@pytest.mark.parametrize("bounds", [{}, {"max_words": 3}, {"max_asked": 4, "cell_rows": 30}, {"max_words": 3, "max_asked": 4, "cell_rows": 1000}])
def test_sparse_top_k_equals_word_by_word(spark, bounds):
    r = random.Random(3)
    words = ["the", "motor", "Battery", "range", "überhitzt", "a1", "low", "x"] + [f"w{i}" for i in range(30)]
    chunks = [(i, r.choice("aab"), " ".join(r.choices(words, weights=[30, 20, 10] + [2] * (len(words) - 3), k=r.randint(0, 40)))) for i in range(250)]
    chunks += [(300, "a", None), (301, "a", ""), (302, "c", "motor")] + [(400 + i, "a", "motor range") for i in range(20)]
    queries = [(i, r.choice("abd"), " ".join(r.choices(words, k=r.randint(1, 6)))) for i in range(25)] + [(50, "a", "motor motor range"), (51, "a", "the"), (52, "a", "")]
    q = spark.createDataFrame(queries, "query_id long, domain string, query string")
    c = spark.createDataFrame(chunks, "chunk_id long, domain string, content string").repartition(5)
    got = {(x["query_id"], x["chunk_id"]): (x["rank"], round(x["score"], 6)) for x in search.sparse_top_k(q, c, 5, **bounds).collect()}
    assert got == plain_bm25(queries, chunks, 5)


def test_blocks_under_the_kth_score_are_passed_by():
    import numpy as np

    side = search._Side(np.array([1]), np.array([7]), np.array([2.0]), 10.0, 2)
    for first in (0, 100, 200):
        side.meet(np.arange(first, first + 50), np.full(50, 5.0 if not first else 20.0), np.full(50, 7), np.ones(50), np.ones(50, dtype=int))
        if not first:
            kth = side.best[1]
    assert side.best[1] is kth and side.best[1][1].tolist() == [0, 1]


def test_resolution_sparse_and_padded_fleet(spark):
    got = resolve(spark, ["VIN-10422", "VIN-1O42"], ["VIN-1042", "VIN-2077", "VIN-3150"])
    assert (got["VIN-10422"]["status"], got["VIN-10422"]["value"]) == ("fuzzy", "VIN-1042")
    assert got["VIN-1O42"]["status"] == "ambiguous" and got["VIN-1O42"]["suggestions"] == ["VIN-1042"]
    got = resolve(spark, ["42", "V42", "v 42", "v-42", "V-042", "V042", "V 0042", "V-999"], [f"V-{i:03d}" for i in range(1, 121)])
    assert all(got[s]["value"] == "V-042" for s in got if s != "V-999") and got["V-999"]["status"] != "exact"


def test_close_pairs_find_every_pair(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("AB12") for _ in range(n))
    left = sorted({word(r.randint(1, 9)) for _ in range(60)} | {word(18) for _ in range(6)})
    right = sorted({word(r.randint(1, 9)) for _ in range(60)} | {left[-1] + "Z", word(17)})
    a = spark.createDataFrame([(x, x) for x in left], "raw string, q string")
    b = spark.createDataFrame([(x, x) for x in right], "known string, n string")
    want = {(x, y) for x in left for y in right if fuzzy.indel_ratio(x, y) >= 78}
    assert {(p["raw"], p["known"]) for p in matching.close_pairs(a, b, 78.0).collect()} == want


def plain_resolution(raw, known):
    """Status, value and suggestions, id by id."""
    def normal(s):
        return re.sub(r"(^|[^0-9])0+([0-9])", r"\1\2", re.sub(r"[^A-Z0-9]", "", s.upper()))

    q = normal(raw)
    exact = sorted(k for k in known if normal(k) == q)
    if len(exact) == 1:
        return "exact", exact[0], []
    if exact:
        return "ambiguous", None, exact[:3]
    scored = sorted((-fuzzy.indel_ratio(q, normal(k)), k) for k in known)
    strong, close = ([k for s, k in scored if -s >= least] for least in (92, 78))
    if len(strong) == 1:
        return "fuzzy", strong[0], strong
    return ("ambiguous" if close else "not_found"), None, close[:3]


@pytest.mark.parametrize("dense", [True, False])
def test_long_ids_of_a_common_prefix_equal_brute_force(spark, dense):
    r = random.Random(5)
    number = (lambda: 300000 + r.randrange(400)) if dense else (lambda: r.randrange(100000, 999999))
    known = sorted({f"FLEET-EUWEST-A{number()}B{r.randrange(2)}" for _ in range(150)} | {"V-7", "TRUCK-12", "SHORT1"})
    raws = [k for k in known[:5]]
    for _ in range(40):
        s = list(r.choice(known))
        for _ in range(r.randint(1, 4)):
            at = r.randrange(len(s))
            s[at:at + r.randint(0, 1)] = [r.choice(["", "1", "X", "0"])]
        raws.append("".join(s))
    raws += ["FLEET-ASIAEAST-99", "FLEETEUWESTA", "GARBAGE" * 5, "TRUCK-13", "".join(r.choices("ABC123", k=22))]
    got = resolve(spark, sorted(set(raws)), known)
    for raw in set(raws):
        if raw.strip():
            assert (got[raw]["status"], got[raw]["value"], got[raw]["suggestions"]) == plain_resolution(raw, known), raw


@pytest.mark.parametrize("most", [10_000, 5])
def test_ids_of_numbers_without_gaps_meet_few_at_the_loose_score(spark, monkeypatch, most):
    known = [f"V-{i:06d}" for i in range(100000, 100600)]
    raws = sorted({f"{k[:6]}{k[7]}{k[6]}9" for k in known[::3]} | {f"{k[:5]}X{k[6:]}" for k in known[::40]} | {"V-9", "V-177777"})
    met, pairs = {}, matching.close_pairs

    def counted(left, right, score):
        met[score] = left.count()
        return pairs(left, right, score)

    monkeypatch.setattr(matching, "close_pairs", counted)
    monkeypatch.setattr(matching, "MOST_LOOSE", most, raising=False)
    got = resolve(spark, raws, known)
    for raw in raws:
        assert (got[raw]["status"], got[raw]["value"], got[raw]["suggestions"]) == plain_resolution(raw, known), raw
    assert max(met) == ref.AUTO_ACCEPT_SCORE and met[ref.DISAMBIGUATE_SCORE] < met[ref.AUTO_ACCEPT_SCORE] / 4 and len(met) == (3 if most == 5 else 2)


def test_pieces_find_every_pair(spark):
    r = random.Random(8)
    left = sorted({"".join(r.choices("AB1", k=r.randint(3, 26))) for _ in range(80)})
    right = sorted({x[:r.randint(0, len(x))] + r.choice(["", "A", "1B"]) + x[r.randint(0, len(x)):] for x in left for _ in range(2)} - {""})
    a = spark.createDataFrame([(x, x) for x in left], "raw string, q string")
    b = spark.createDataFrame([(x, x) for x in right], "known string, n string")
    for score in (70.0, 78.0, 92.0):
        want = {(x, y) for x in left for y in right if fuzzy.indel_ratio(x, y) >= score}
        assert {(p["raw"], p["known"]) for p in matching.close_pairs(a, b, score).collect()} == want and len(want) > 20
    with pytest.raises(ValueError):
        matching.close_pairs(a, b, 60.0)


def test_candidate_arms_equal_brute_force(spark):
    r = random.Random(6)
    known = sorted({f"V-{i:04d}" for i in range(0, 300, 3)} | {f"{r.choice(['TRUCK', 'van', 'Bus'])} {i}" for i in range(40)} | {"--", "v-0003"})
    raws = ["v-0003", "V-12", "truck 1", "TRUK", "bus", "0", " ", "--", "12 V", "zzz"] + [f"V{i}" for i in range(0, 40, 7)]

    def grams(s):
        return {f"  {w} "[i:i + 3] for w in re.findall(r"[^\W_]+", s.lower()) for i in range(len(w) + 1)}

    def rank(raw, x):
        a, b = grams(raw), grams(x)
        return raw.lower() != x.lower(), -len(a & b) / max(len(a | b), 1), x

    want = set()
    for raw in raws:
        digits = re.search("[0-9]+", raw)
        digits = digits and re.sub("^0+(?=[0-9])", "", digits.group())
        if re.sub("[^A-Z0-9]", "", raw.upper()):
            arms = [x for x in known if raw.lower() == x.lower() or -rank(raw, x)[1] >= 0.2 or digits and digits in x]
            want |= {(raw.strip(), x, i) for i, x in enumerate(sorted(arms, key=lambda x: rank(raw, x))[:7], 1)}
    r_, k_ = spark.createDataFrame([(x,) for x in raws], "raw string"), spark.createDataFrame([(x,) for x in known], "known string")
    got = matching.candidate_arms(r_, k_, 7)
    assert {(x["raw"], x["known"], x["position"]) for x in got.collect()} == want
    spelled = r_.where("trim(raw) <> ''")
    one = matching.trigram_candidates(spelled, k_, 4)
    assert rows(one, "raw", "known", "similarity") == rows(matching.trigram_candidates(spelled, k_, 4, block_rows=3, cell_rows=20), "raw", "known", "similarity")
    assert matching.trigram_candidates(spelled, k_.limit(0)).collect() == []


def test_trigram_search_reads_few_ids_and_finds_the_best(monkeypatch):
    import numpy as np

    r = random.Random(9)
    known = sorted({f"V-{i:06d}" for i in range(4000)} | {f"V-{i}" for i in range(40)} | {"TRUCK 7", "V"})
    numbers = {}

    def grams(s):
        return np.array([numbers.setdefault(g, len(numbers)) for g in dict.fromkeys(f"  {w} "[i:i + 3] for w in re.findall("[a-z0-9]+", s.lower()) for i in range(len(w) + 1))])

    each = [grams(x) for x in known]
    index = matching._Trigrams(np.concatenate(each), np.array([len(g) for g in each]))
    read, sort = [], np.sort
    for k, least in ((50, 0.2), (3, 0.2), (50, 0.7), (100_000, 0.1)):
        for raw in [f"V-{r.randrange(4000):05d}9" for _ in range(6)] + ["V", "truck", "V-7", "000", "V-000000", "zzz", known[5], "TRUCK-12 V-000100"]:
            mine = grams(raw)
            both = np.array([np.isin(mine, g).sum() for g in each])
            share = both / (len(mine) + np.array([len(g) for g in each]) - both)
            want = [i for i in np.argsort(-share, kind="stable").tolist() if share[i] >= least][:k]
            rows, similar = index.best(mine, k, least)
            assert rows.tolist() == want and similar.tolist() == share[want].tolist(), (raw, k)
    monkeypatch.setattr(np, "sort", lambda a: read.append(len(a)) or sort(a))
    index.best(grams("V-012349"), 5, 0.2)
    assert sum(read) < len(known) / 4


def test_one_cell_of_ids_gives_k_rows_an_id(spark, monkeypatch):
    known = spark.range(3000).select(F.format_string("V-%06d", "id").alias("known"))
    raws = known.select(F.concat(F.substring("known", 1, 6), F.lit("x"), F.substring("known", 7, 2)).alias("raw"))
    many = rows(matching.trigram_candidates(raws, known, 5, block_rows=400, cell_rows=400), "raw", "known", "similarity", "position")
    monkeypatch.setattr(matching, "MOST_BLOCK", 400)
    one = matching.trigram_candidates(raws, known, 5, block_rows=100)
    assert "Window" not in one._jdf.queryExecution().executedPlan().toString() and rows(one, "raw", "known", "similarity", "position") == many


def test_near_duplicates_find_every_pair(spark):
    r = random.Random(7)
    vocabulary = ["range", "drop", "why", "did", "battery", "speed", "low", "on", "it", "motor"]
    qs = [" ".join(r.choices(vocabulary, k=r.randint(2, 8))) for _ in range(120)] + ["why  RANGE drop"] * 40
    data = [(i, q, "x" if i % 3 else "y") for i, q in enumerate(qs)]
    df = spark.createDataFrame(data, "id long, question string, answer string")
    forms = {}
    for i, q, a in data:
        forms.setdefault((a, " ".join(sorted(set(q.lower().split())))), i)
    want = {tuple(sorted((i, j))) for ((a, x), i), ((b, y), j) in itertools.combinations(forms.items(), 2) if a == b and fuzzy.token_set(x, y) >= 90}
    for cell_rows in (7, 5000):
        assert {(p["id_a"], p["id_b"]) for p in matching.near_duplicates(df, 90.0, cell_rows).collect()} == want
    assert sum(c["copies"] for c in matching.copies(df).collect()) > 40


def wordings(r, n, vocabulary):
    """Texts and what edits of letters, blanks and words make of them."""
    out = []
    while len(out) < n:
        words = r.choices(vocabulary, k=r.randint(1, 14))
        for _ in range(r.randint(1, 5)):
            out.append(" ".join(words))
            edited = list(" ".join(words))
            for _ in range(r.randint(1, 3)):
                at = r.randrange(len(edited) + 1)
                edited[at:at + r.randint(0, 1)] = [r.choice(["", "x", " ", "é", *edited[at:at + 1]])]
            words = "".join(edited).split() or ["x"]
            if r.random() < 0.3:
                words = words[:r.randint(1, len(words))] + r.choices(vocabulary, k=r.randint(0, 2))
    return out


@pytest.mark.parametrize("threshold, vocabulary", [
    (95.0, ["battery", "range", "it", "a", "temperature", "überhitzt", "charging", "on", "10"]), (85.0, ["battery", "range", "it", "a", "temperature", "charging"]),
    (95.0, ["a", "b", "ab", "ba", "aab", "abb"]), (78.0, ["a", "bb", "abc", "motor"])])
def test_near_wordings_equal_brute_force(spark, threshold, vocabulary):
    r = random.Random(int(threshold) + len(vocabulary))
    data = [(i, q, r.choice(["x", "x", "y", None])) for i, q in enumerate(wordings(r, 260, vocabulary))]
    forms = {}
    for i, q, a in data:
        forms.setdefault((a, " ".join(sorted(set(q.lower().split())))), i)
    want = {tuple(sorted((i, j))) for ((a, x), i), ((b, y), j) in itertools.combinations(forms.items(), 2) if a == b and fuzzy.token_set(x, y) >= threshold}
    got = matching.near_duplicates(spark.createDataFrame(data, "id long, question string, answer string"), threshold).collect()
    assert {(p["id_a"], p["id_b"]) for p in got} == want and len(got) == len(want) > 20


def test_only_pairs_that_agree_become_rows(spark):
    r = random.Random(5)
    syllables = ["th", "er", "on", "an", "in", "re", "ed", "es"]
    texts = [" ".join(sorted({"".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(150)})) for _ in range(60)]
    texts += [texts[0].replace("there", "thera", 1) + " x", texts[1] + " zz"]
    forms = spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(texts)], "_g long, _id long, _side int, words string")
    near = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if fuzzy.token_set(a, b) >= 95}
    got = {tuple(x) for x in matching._by_letters(forms, 95.0).collect()}
    assert got == near and {(0, 60), (1, 61)} <= near and len(near) < 10
    # Blocks of a class of lengths meet each other, and no pair twice.
    few, matching.UNIT_LETTERS = matching.UNIT_LETTERS, 3_000
    try:
        again = [tuple(x) for x in matching._by_letters(forms, 95.0).collect()]
    finally:
        matching.UNIT_LETTERS = few
    assert set(again) == near and len(again) == len(near)


def test_near_wordings_need_a_threshold_that_runs_can_prove(spark):
    with pytest.raises(ValueError):
        matching.near_duplicates(spark.createDataFrame([(1, "a b", "x")], "id long, question string, answer string"), 60.0).collect()


def test_agreement_equals_token_set_where_it_counts():
    r = random.Random(3)
    for _ in range(1500):
        words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 30))]
        other = [w if r.random() < 0.7 else w[:1] + r.choice("ab") + w[1:] for w in words if r.random() < 0.97] or ["q"]
        a, b = (" ".join(sorted(set(x))) for x in (words, other))
        want = fuzzy.token_set(a, b)
        for threshold in (76.0, 95.0):
            got = matching._agree(a, b, threshold)
            assert got == want if want >= threshold else got < threshold


def test_similar_cases_equal_brute_force(spark):
    r = random.Random(11)
    texts = wordings(r, 200, ["battery", "range", "it", "a", "temperature", "charging", "low", "speed"])
    drafts = [(i, q) for i, q in enumerate(texts[::3])] + [(500, None), (501, " "), (502, texts[0])]
    cases = [(i, q) for i, q in enumerate(texts[1::3] + texts[:5])] + [(700, texts[1]), (701, "")]
    got = matching.similar_cases(spark.createDataFrame(drafts, "id long, question string"), spark.createDataFrame(cases, "id long, question string")).collect()

    def form(q):
        return " ".join(sorted(set((q or "").lower().split())))

    first, number = {}, {}
    for i, q in cases:
        first[form(q)] = min(i, first.get(form(q), i))
        number[form(q)] = number.get(form(q), 0) + 1
    want = {(d, first[c], number[c]) for d, q in drafts for c in first if form(q) and c and fuzzy.token_set(form(q), c) >= 85}
    assert {(x["id"], x["case_id"], x["copies"]) for x in got} == want and len(got) == len(want) > 30


# documents and stored tables

def test_ingest_ledger(spark):
    from fleetlens.functions import text
    stored = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, raw string").select("doc_id", text.content_hash(F.col("raw")).alias("content_hash"))
    incoming = spark.createDataFrame([(1, "one "), (2, "two changed"), (3, "new"), (4, "new"), (5, " \n"), (6, "two")], "doc_id long, raw string")
    got = {r["doc_id"]: r["status"] for r in documents.ingest_status(incoming, stored).collect()}
    assert got == {1: "skipped_duplicate", 2: "replaced", 3: "ingested", 4: "skipped_duplicate", 5: "failed", 6: "skipped_duplicate"}


def test_promotion_and_duplicate_codes(spark):
    body = ("| Error Code | System | Meaning | Level |\n|---|---|---|---|\n| ERR_401 | Pack | hot | high |\n| ERR_401, ERR_402 | x | y | z |\n| ERR_403 | | cold | |\n\n"
            "| DTC | Description |\n|---|---|\n| ERR_401 | hotter |\n\n| a | b |\n|---|---|\n| ERR_900 | no |\n")
    got = {r["code"]: r for r in documents.promote_codes(spark.createDataFrame([(1, body)], "doc_id long, body string")).collect()}
    assert set(got) == {"ERR_401", "ERR_403"} and got["ERR_401"]["meaning"] == "hotter" and got["ERR_403"]["subsystem"] is None


def test_term_search(spark):
    c = spark.createDataFrame([(1, "The collapsible stand"), (2, "Fill to 32 PSI, please"), (3, "psi_meter")], "doc_id long, content string")
    t = spark.createDataFrame([(9, " psi "), (8, "32 psi")], "trap_id long, term string")
    for bound in (10, 1):
        got = documents.find_terms(c, t, bound).collect()
        assert {(r["trap_id"], r["doc_id"]) for r in got} == {(9, 2), (8, 2)}
        assert all(r["context"] == "Fill to 32 PSI, please" for r in got)


def test_pages_to_documents(spark):
    pages = spark.createDataFrame([(1, "http://a/x/", "T", "Home\nIntro\nBrand one\n5 min read\nIntro\nshare"), (2, "http://a/y", "T", "has Secret"), (3, "http://a/z", "T", "x"), (4, "http://b", "T", "x")],
                                  "page_id long, url string, title string, text string")
    sources = spark.createDataFrame([("http://a/x", "business", False), ("http://a/y/", "business", False), ("http://a/z", "business", True)], "url string, domain string, skip boolean")
    got = {r["page_id"]: r for r in documents.clean_pages(pages, sources, {"Brand": "B"}, ["Secret"]).collect()}
    assert set(got) == {1, 2} and got[1]["body"] == "B one\n\nIntro" and got[2]["status"] == "refused"


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "k long, v string, t long")
    assert rows(upsert.upsert(stored, new, ["k"], ["t"]), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(upsert.insert_absent(stored, new, ["k"]), "k") == [(3,)]
    assert rows(upsert.replace_groups(stored, new, "k"), "k", "v") == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]


def test_folder_scan_reports_bad_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# ok\n")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.png").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["raw"]) for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("ok", "# ok\n"), "b.txt": ("failed", None)}


def test_jsonl_skips_blank_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert rows(files.read_jsonl(spark, str(tmp_path), "id string"), "id") == [("a",), ("b",)]


def test_lower_bound_is_required_and_pushed_down(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    with pytest.raises(ValueError):
        tables.since(events, "ts", "")
    plan = tables.since(events, "ts", "2024-01-20")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


# answers

def audit_case(spark, answer, evidence, question="q"):
    a = spark.createDataFrame([("a", question, answer, False, "complete")], "answer_id string, question string, answer string, partial boolean, stop_reason string")
    e = spark.createDataFrame([("a", *x) for x in evidence],
                              "answer_id string, evidence_id string, status string, trust_level string, source_doc string, verdict string, quality_warning string, "
                              "summary string, actual double, baseline double, delta_pct double, rerank_score double")
    return a, e


def ev(i, status="ok", trust="internal", doc=None, verdict="above_normal", warning=None, summary="", actual=None, baseline=None, delta=None):
    return (i, status, trust, doc, verdict, warning, summary, actual, baseline, delta, None)


def test_number_grounding(spark):
    e = [ev("e1", summary="current 38.2 A", actual=38.2, baseline=28.0, delta=36.4), ev("e2", summary="range 61 km")]
    bad = lambda s, q="q": rows(audit.untraceable(*audit_case(spark, s, e, q)), "raw")
    assert bad("Draw is 36% above [e1]. After 3 laps.") == []
    assert bad("Range is 61 km [e1].") == [("61",)]                 # right number, wrong citation
    assert bad("Range is 61 km.") == [] and bad("It is 77.7.") == [("77.7",)]
    assert bad("It is 77.7 [e1].", "was it 77.7?") == []


def test_causal_grounding(spark):
    flagged = lambda s, *e: audit.unsupported_causes(*audit_case(spark, s, e)).count()
    assert flagged("High because of overload [e1].", ev("e1")) == 0
    assert flagged("High because of overload [e1].", ev("e1", trust="external")) == 1
    assert flagged("High because of overload [e1].", ev("e1", warning="fault")) == 1
    assert flagged("High because of overload [e1].", ev("e1", status="below_threshold")) == 1
    assert flagged("The cause cannot be established because no document covers it.", ev("e1")) == 0
    assert flagged("It is due to overload, although wear cannot be ruled out.", ev("e1")) == 1


def test_citations_and_confidence(spark):
    a, e = audit_case(spark, "One [e1]. Two [e1][e2].\nOne [e1].", [ev("e1"), ev("e2"), ev("e3")])
    assert rows(audit.citations(a), "claim", "evidence_id") == [("One .", "e1"), ("Two .", "e1"), ("Two .", "e2")]
    assert audit.confidence(a, e).first()["confidence"] == "high"
    a, e = audit_case(spark, "One [e1] and [e7].", [ev("e1")])
    assert rows(audit.unresolved(a, e), "evidence_id") == [("e7",)] and audit.confidence(a, e).first()["confidence"] == "medium"
    a, e = audit_case(spark, "One [e1].", [ev("e1", status="empty")])
    assert audit.confidence(a, e).first()["confidence"] == "low"


def test_run_diff(spark):
    kind = "id string, status string, pass boolean, checks array<struct<name:string,passed:boolean>>, judge_pass boolean"
    now = spark.createDataFrame([("a", "ok", False, [("facts", False)], None), ("b", "ok", True, [], None), ("c", "infra", False, [], None), ("d", "ok", True, [], None)], kind)
    then = spark.createDataFrame([("a", "ok", True, [], None), ("b", "ok", False, [], None), ("c", "ok", True, [], None), ("e", "ok", True, [], None)], kind)
    assert rows(evaluation.diff_runs(now, then), "id", "change", "now_failing") == [("a", "regression", "facts"), ("b", "fixed", "")]


# feedback and metrics

def clusters(spark, outcome, vehicle=None):
    import json
    df = spark.createDataFrame([("t", None if outcome is None else json.dumps(outcome), vehicle)], "turn_id string, outcome string, vehicle_id string")
    return feedback.with_signature(df).first()["signals"]


def test_signatures(spark):
    ok = {"tools_selected": ["structured_query_tool"], "domains": ["diagnostic"], "grounded": True, "stop_reason": "complete", "latency_ms": 5000}
    assert clusters(spark, ok) == ["no_signal"] and clusters(spark, None) == ["no_signal"]
    assert clusters(spark, {**ok, "latency_ms": 30000}) == ["slow"]
    assert clusters(spark, {**ok, "domains": ["business"]}, "V-042") == ["wrong_domain"]
    assert clusters(spark, {**ok, "tools_selected": []}) == ["wrong_tool"]
    assert clusters(spark, {**ok, "node_errors": ["router: x", "plan: y"]}) == ["wrong_domain", "step_failed"]
    assert clusters(spark, {**ok, "evidence_statuses": ["structured_query_tool:failed", "rag_retrieval_tool:empty"]}) == ["sql_failed", "empty_retrieval"]
    assert clusters(spark, {**ok, "grounded": False, "stop_reason": "timeout", "latency_ms": 30000}) == ["grounding_failure", "hit_limit"]


def test_rephrase(spark):
    t = dt.datetime(2024, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    turns = spark.createDataFrame([
        ("s", 1, "why is V-042's range so low", s(0), s(5)), ("s", 2, "Why did range drop on V-042?", s(17), s(20)), ("s", 3, "and V-017?", s(25), None),
        ("r", 4, "why is V-042's range so low", s(0), None), ("r", 5, "Why did range drop on V-042?", s(45), None)],
        "session_id string, turn_id long, question string, created_at timestamp, ended_at timestamp")
    assert rows(feedback.rephrased(turns), "turn_id", "gap_s") == [(1, 12.0)]
    flags = lambda rating: spark.createDataFrame([(1, rating), (99, "implicit_down")], "turn_id long, rating string")
    assert rows(feedback.rephrased(turns, flags=flags("down")), "turn_id", "gap_s") == [(1, 12.0)]
    assert feedback.rephrased(turns, flags=flags("implicit_down")).count() == 0  # flagged already


def test_queue_is_biggest_first_one_item_per_turn(spark):
    t = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([(1, "t1", "down", "slow", "new", t), (2, "t1", "implicit_down", "slow", "new", t), (3, "t2", "down", "sql_failed", "new", t),
                                   (4, "t3", "down", "sql_failed", "new", t), (5, "t4", "down", "slow", "dismissed", t)],
                                  "id long, turn_id string, rating string, cluster string, review_status string, created_at timestamp")
    assert [(r["cluster"], r["turn_id"], r["flag_id"]) for r in feedback.queue(items).collect()] == [("sql_failed", "t2", 3), ("sql_failed", "t3", 4), ("slow", "t1", 1)]


def test_quantile_beyond_last_bound(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (500.0,), (600.0,)], "v double")
    h = opsmetrics.histogram(df, [], "v", [1.0, 2.0])
    assert [r["count"] for r in h.orderBy("le").collect()] == [1, 2, 4]
    assert opsmetrics.histogram_quantile(h, [], 0.5).first()["quantile"] == 2.0
    assert opsmetrics.histogram_quantile(h, [], 0.95).first()["quantile"] == 2.0


def test_hash_sample_is_repeatable(spark):
    df = spark.range(4000).select(opsmetrics.hash_share(F.col("id").cast("string")).alias("s"))
    share = df.where("s < 0.1").count() / 4000
    assert 0.07 < share < 0.13


def test_units_are_kept(spark):
    at = dt.datetime(2024, 1, 1, 5, 30)
    readings = spark.createDataFrame([(1, "soc", "Eco", at, 50.0, "%"), (1, "soc", "Eco", at, 70.0, None), (2, "temp", None, at, 3.0, None)],
                                     "vehicle_id long, metric_name string, drive_mode string, recorded_at timestamp, metric_value double, unit string")
    hours = rollup.hourly(readings)
    assert rows(hours, "vehicle_id", "avg_value", "unit") == [(1, 60.0, "%"), (2, 3.0, None)]
    assert rows(rollup.rebucket(hours, 86400, ["vehicle_id"]), "vehicle_id", "readings", "unit") == [(1, 2, "%"), (2, 1, None)]
    vehicles = spark.createDataFrame([(1, "M"), (2, "M")], "vehicle_id long, model_code string")
    baselines = spark.createDataFrame([("M", "Eco", "soc", 40.0, 15.0)], "model_code string, drive_mode string, metric_name string, nominal_value double, tolerance_pct double")
    assert rows(diagnose.compare(readings, vehicles, baselines, ["vehicle_id"]), "vehicle_id", "actual", "unit") == [(1, 60.0, "%")]
    assert "unit" not in rollup.hourly(readings.drop("unit")).columns


# stored tables that change in place

def test_stored_table_rewrites_touched_buckets_only(spark, tmp_path):
    from fleetlens.sources.stored import Stored

    first = spark.createDataFrame([(i, f"v{i}", i) for i in range(500)] + [(None, "null key", 0)], "k long, v string, n long")
    table = Stored.create(first, str(tmp_path / "t"), ["k"], 100)
    names = lambda t: {f.rsplit("/data/", 1)[1] for f in t.read().inputFiles()}
    before = names(table)
    incoming = spark.createDataFrame([(3, "a", 1), (3, "b", 2), (900, "new", 0), (None, "no", 1)], "k long, v string, n long")
    table = table.upsert(incoming, ["n"])
    again = Stored(spark, str(tmp_path / "t"))  # a second read sees the change
    assert rows(again.read(), "k", "v", "n") == rows(upsert.upsert(first, incoming, ["k"], ["n"]), "k", "v", "n")
    assert len(before - names(table)) <= 3 and len(before & names(table)) > 90
    assert rows(Stored(spark, str(tmp_path / "t"), 0).read(), "k", "v", "n") == rows(first, "k", "v", "n")  # and so does a reader of the old version
    table = table.insert_absent(spark.createDataFrame([(3, "no", 0), (901, "yes", 0)], "k long, v string, n long"))
    table = table.replace_groups(spark.createDataFrame([(5, "five", 1), (5, "cinq", 2)], "k long, v string, n long"))
    table = table.delete(spark.createDataFrame([(6,), (77777,)], "k long"))
    got = {(r["k"], r["v"]) for r in table.read().where("k IN (3, 5, 6, 900, 901)").collect()}
    assert got == {(3, "b"), (5, "five"), (5, "cinq"), (900, "new"), (901, "yes")}
    kept = table.keep_configured(spark.createDataFrame([(k,) for k in range(490)], "k long"))
    assert kept.read().agg(F.max("k")).first()[0] == 489
    assert len(names(table) & names(kept)) > 50
    empty = kept.delete(kept.read().select("k"))
    assert empty.read().where("k IS NOT NULL").count() == 0 and empty.read().columns == ["k", "v", "n"]


def test_two_writers_of_one_version(spark, tmp_path):
    from fleetlens.sources.stored import Stored

    path = str(tmp_path / "t")
    Stored.create(spark.createDataFrame([(1, "a")], "k long, v string"), path, ["k"], 4)
    one, two = Stored(spark, path), Stored(spark, path)
    one.upsert(spark.createDataFrame([(1, "b")], "k long, v string"), ["v"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        two.upsert(spark.createDataFrame([(1, "c")], "k long, v string"), ["v"])
    assert [r["v"] for r in Stored(spark, path).read().collect()] == ["b"]


def test_vectors_of_one_model(spark, tmp_path):
    from fleetlens.sources.stored import Stored

    kind = "doc_id long, embedding array<float>"
    path = str(tmp_path / "v")
    table = documents.store_vectors(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], kind), path, "small", 2, 8)
    table = documents.add_vectors(table, spark.createDataFrame([(3, [9.0, 9.0]), (30, [0.0, 1.0])], kind), "small")
    assert documents.vectors_of(table, "small").count() == 21
    for refused in (lambda: documents.vectors_of(table, "large"), lambda: documents.add_vectors(table, table.read(), "large"),
                    lambda: documents.reembed(table, spark.createDataFrame([(1, [1.0, 2.0, 3.0])], kind), "large", 3)):
        with pytest.raises(ValueError):
            refused()
    with pytest.raises(Exception, match="another model"):
        documents.add_vectors(table, spark.createDataFrame([(4, [1.0])], kind), "small")
    assert Stored(spark, path).version == table.version
    full = table.read().select("doc_id", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).cast("array<float>").alias("embedding"))
    large = documents.reembed(table, full, "large", 3)
    old, new = Stored(spark, path, table.version), Stored(spark, path)
    assert documents.vectors_of(old, "small").where("size(embedding) != 2").count() == 0
    assert documents.vectors_of(new, "large").where("size(embedding) != 3").count() == 0 and new.version == large.version


def equals_sql(spark, folder, name):
    """Rows of a query and of its SQL over the tables in a folder."""
    import glob
    import os

    import duckdb

    from fleetlens.plans import catalogue
    from tools.check import cell
    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalogue.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    cur = db.execute(catalogue.ORACLES[name])
    have = [d[0] for d in cur.description]
    want = sorted(str(tuple(cell(r[have.index(c)]) for c in cols)) for r in cur.fetchall())
    assert sorted(str(tuple(cell(r[c]) for c in cols)) for r in df.collect()) == want and want


def write_documents(folder, ids, n_chars):
    import pandas as pd
    pd.DataFrame({"doc_id": ids, "text": [f"text of {i}" for i in ids], "lang": "en", "source": [f"src{i % 3}" for i in ids],
                  "n_chars": pd.array(n_chars, dtype="Int64")}).to_parquet(folder / "documents.parquet")


def test_codes_of_many_documents_come_again(spark, tmp_path):
    ids = [5, 6, 260_005, 520_005]
    write_documents(tmp_path, ids, [9] * len(ids))
    equals_sql(spark, tmp_path, "dp06_promoted_codes")


def test_numbers_halfway_go_to_the_even_digit(spark, tmp_path):
    n = [3 * x for x in (0, 1, 9999, 10_000, 12_345, 12_355, 12_346, 99_995, 123_450, 123_550, 123_451, 999_950, 1_234_500)] + [29_998, 29_999, 37_036, 299_986, None]
    write_documents(tmp_path, list(range(len(n))), n)
    equals_sql(spark, tmp_path, "sf30_cut_text")


def test_nearest_in_blocks_equals_all_at_once(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(3)
    v = search._unit(list(np.round(rng.normal(size=(700, 3)), 1)))
    v[100:400] = v[0]                                     # many copies: ties at every place
    ids = rng.permutation(700)
    scores = np.round(v @ v.T, 6)
    for k in (1, 5, 40):
        want = [sorted(zip(-row, ids))[:k] for row in scores]
        for block in (8 * 700 * 3, 8 * 700 * 90, 16 << 20):
            monkeypatch.setattr(search, "BLOCK_BYTES", block)
            best = None
            for part in np.array_split(np.arange(700), 3):
                best = search._nearest(v, ids[part], v[part], k, best)
            assert [list(zip(-s, i)) for s, i in zip(*best)] == want
    few = search._hits(ids, search._nearest(v, ids[:2], v[:2], 5))
    assert len(few) == 1400


def test_nearest_blocks_of_many_rows_stay_few():
    # Each row is sent once a block or cell of the other side.
    assert skew.grid(1_000, 200, 32_768) == 5 and skew.grid(100_000, 200, 32_768) == 8
    assert skew.grid(615_000, 200, 32_768) == skew.grid(615_000, 4_096, 32_768) == 19
    assert skew.grid(100, 4_096, 32_768) == 1
    assert skew.grid(900_000, 10_000, matching.MOST_CELL) == 8 and skew.grid(5_400_000, 10_000, matching.MOST_CELL) == 21


def test_search_queries_join_no_texts(spark):
    from fleetlens.plans import retrieval
    from fleetlens.plans.bindings import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    assert retrieval.chunk_table(t).select("chunk_id", "content")._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert "text:string" not in retrieval.chunk_vectors(t)._jdf.queryExecution().executedPlan().toString()


def test_texts_go_through_python_in_slices():
    import pandas as pd

    from fleetlens.functions import markdown, plugins, text
    texts = pd.Series(["a b " * 50_000, None, "", "x"] * 30)
    titles = pd.Series(["t"] * len(texts))
    parts = list(markdown.split_chunks.func(iter([(texts, titles)])))
    assert len(parts) > 1 and [c for p in parts for c in p] == [markdown.chunks(s or "", "t") for s in texts]
    parts = list(plugins.encoder(plugins.hashing_model).func(iter([texts])))
    assert len(parts) > 1 and sum(map(len, parts)) == len(texts)
    assert [len(texts[p]) for p in text.slices(["abc", "", "abcd", "a"], 5)] == [3, 1]
    assert list(text.slices([])) == []


def test_ids_are_matched_without_gathering_them_on_the_driver(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "ids"))
    known = spark.read.parquet(str(tmp_path / "ids")).select(F.format_string("V-%06d", "id").alias("known"))
    raws = known.select(F.concat("known", F.lit("9")).alias("raw"))
    close = matching.close_pairs(raws.withColumn("q", F.col("raw")), known.withColumn("n", F.col("known")), 78.0)
    for df in (close, matching.resolve(raws, known), matching.candidate_arms(raws, known)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
