"""Rows that ordinary test data happens not to contain."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions import text
from fleetlens.operators import diagnose, search, skew
from fleetlens.plans import catalogue
from fleetlens.plans.bindings import Tables

EVENTS = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"


def folder(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{path}/events.parquet")
    return str(path)


def event(i, value, day=dt.datetime(2024, 1, 5), user=1, kind="click"):
    return (i, user, day, kind, value, '{"k": 1}')


def test_ranks_keep_missing_readings(spark, tmp_path):
    where = folder(spark, tmp_path, [event(1, 5.0), event(2, None), event(3, 7.0), event(4, None)])
    got = {r["id"]: (r["row_no"], r["rank_no"], r["dense_no"]) for r in catalogue.QUERIES["w01_ranks"](spark, where).collect()}
    assert got == {3: (1, 1, 1), 1: (2, 2, 2), 2: (3, 3, 3), 4: (4, 3, 3)}


def test_old_readings_are_read(spark, tmp_path):
    where = folder(spark, tmp_path, [event(1, 5.0), event(2, 6.0, dt.datetime(1999, 1, 1))])
    assert Tables(spark, where).telemetry.count() == 2


def test_percentiles_of_a_key_without_values(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None), (None, 3.0)], "k long, v double")
    got = {r["k"]: r["m"] for r in skew.percentiles(df, ["k"], "v", {"m": ("cont", 0.5)}).collect()}
    assert got == {1: 3.0, 2: None, None: 3.0}


def test_facts_are_not_capped(spark):
    line = " ".join(f"{i}.5 kWh" for i in range(1, 41))
    got = spark.createDataFrame([(line,)], "s string").select(text.facts(F.col("s"), {"energy": r"([\d.]+) kWh"}).alias("f")).first()["f"]
    assert len(got["energy"]) == 40


VEHICLES = [(1, "A"), (2, "B"), (3, "A")]
BASELINES = [("A", "Eco", "draw", 40.0, 10.0, 100.0), ("A", "Sport", "draw", 50.0, None, 100.0), ("B", "Eco", "draw", 0.0, 0.0, 90.0), ("A", "Eco", "load", 60.0, None, 80.0)]


def fleet(spark, rows):
    day = dt.datetime(2024, 1, 1)
    clean = spark.createDataFrame([(i, v, day + dt.timedelta(hours=i), m, x, mode) for i, (v, m, x, mode) in enumerate(rows)], "id long, vehicle_id long, recorded_at timestamp, metric_name string, metric_value double, drive_mode string")
    vehicles = spark.createDataFrame(VEHICLES, "vehicle_id long, model_code string")
    baselines = spark.createDataFrame(BASELINES, "model_code string, drive_mode string, metric_name string, nominal_value double, tolerance_pct double, rated_payload double")
    return clean, vehicles, baselines


READINGS = [
    (1, "draw", 44.0, "Eco"), (1, "draw", 60.0, "Sport"), (1, "draw", None, "Eco"), (1, "draw", 70.0, None), (2, "draw", 3.0, "Eco"),
    (1, "load", 85.0, "Eco"), (1, "load", 70.0, "Eco"), (1, "health", 90.0, None), (1, "health", 80.0, "Eco"), (3, "health", None, None)]


def test_summing_first_gives_the_means_of_the_rows(spark):
    clean, vehicles, baselines = fleet(spark, READINGS)
    for how in ("inner", "left"):
        rows = diagnose.with_baseline(clean, vehicles, baselines, how).groupBy("vehicle_id", "metric_name").agg(
            F.avg("metric_value").alias("actual"), F.avg("nominal_value").alias("baseline"), F.max("tolerance_pct").alias("tolerance_pct"), F.count(F.lit(1)).alias("readings"))
        want = sorted(map(str, diagnose.judge(rows).collect()))
        assert sorted(map(str, diagnose.compare(clean, vehicles, baselines, ["vehicle_id", "metric_name"], how).collect())) == want


def test_fleet_report(spark):
    out = diagnose.fleet_report(*fleet(spark, READINGS), "draw", "speed", "charge", "load", "health")
    got = {r["vehicle_id"]: r for r in out.collect()}
    assert (got[1]["overloads"], got[1]["health_first"], got[1]["health_last"], got[1]["scenario"]) == (1, 90.0, 80.0, "overload")
    assert (got[1]["draw_verdict"], got[2]["draw_verdict"], got[3]["draw_verdict"]) == ("above_normal", "not_applicable", "no_baseline")


def test_a_tie_does_not_hang_on_the_order_of_a_sum(spark):
    means = spark.createDataFrame([(48.74999999999998 + 100, 100.0, 10.0), (148.75, 100.0, 10.0)], "actual double, baseline double, tolerance_pct double")
    assert {r["delta_pct"] for r in diagnose.judge(means).collect()} == {48.8}


CHUNK = "chunk_id long, doc_id long, domain string, content string, applies_to_models array<string>, embedding array<float>"


def test_search_finds_what_has_no_vector(spark):
    chunks = spark.createDataFrame([(1, 1, "d", "the brake pedal", [], None), (2, 2, "d", "the battery pack", [], [1.0, 0.0]), (3, 3, "d", "the the the", [], None)], CHUNK)
    queries = spark.createDataFrame([(1, "d", "the brake", None, []), (2, "d", "the", [1.0, 0.0], [])], "query_id long, domain string, query string, embedding array<float>, terms array<string>")
    got = {(r["query_id"], r["chunk_id"]) for r in search.candidates(queries, chunks).collect()}
    assert got == {(1, 1), (2, 2)}
    kept = search.search(queries, chunks).where("chunk_id IS NOT NULL").collect()
    assert [(r["query_id"], r["chunk_id"], r["rerank_score"]) for r in kept] == [(1, 1, 1.0)]


@pytest.mark.parametrize("block", [1, 400, 64 << 20])
def test_blocks_of_scores_give_the_same_neighbours(monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    r = np.random.default_rng(1)
    q, c, ids = r.normal(size=(9, 4)).round(1), r.normal(size=(70, 4)).round(1), r.permutation(70)
    best = search._nearest(q, ids[:30], c[:30], 5)
    scores, found = search._nearest(q, ids[30:], c[30:], 5, best)
    full = np.round(q @ c.T, 6)
    want = np.lexsort((np.broadcast_to(ids, full.shape), -full), axis=1)[:, :5]
    assert (found == ids[want]).all() and (scores == np.take_along_axis(full, want, 1)).all()
