import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fleetlens import session
from fleetlens.operators import quality, rollup
from fleetlens.streaming import documents, runner, state, telemetry

T0 = dt.datetime(2024, 1, 1)
READING = "id long, vehicle_id long, recorded_at timestamp, metric_name string, metric_value double, drive_mode string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def write_files(spark, path, schema, parts):
    """One file per part, oldest first."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))


def reading(i, hours, value=1.0, metric="m"):
    return (i, i % 2, T0 + dt.timedelta(hours=hours), metric, value, None if i % 3 == 0 else "Eco")


def test_rollup_stream_equals_batch_and_backfill_catches_up(spark, tmp_path):
    early = [reading(i, i / 4, float(i % 9)) for i in range(200)]
    later = [reading(300 + i, 50 + i / 4, 2.0) for i in range(400)]
    in_band = [reading(900 + i, 100 + i / 10, 3.0) for i in range(20)]
    far_late = [reading(1000 + i, 1 + i / 10, 5.0) for i in range(10)]
    write_files(spark, tmp_path, READING, [early, later, in_band, far_late])
    everything = spark.read.parquet(str(tmp_path))
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = telemetry.current_rollup(runner.drain(telemetry.hourly(stream), "rollup", "update"))
    cols = [*rollup.KEYS, "readings", "sum_value"]
    on_time = rollup.hourly(everything.where("id < 1000"))
    assert rows(got, *cols) == rows(on_time, *cols)                 # the far late rows are beyond the watermark
    arrived = everything.where("id >= 1000")
    assert rows(rollup.refresh_touched(got, everything, arrived), *cols) == rows(rollup.hourly(everything), *cols)
    stored = rollup.hourly(everything.where(F.col("recorded_at") < "2024-01-03"))
    assert rows(rollup.realtime(stored, everything, "2024-01-03 00:00:00"), *cols) == rows(rollup.hourly(everything), *cols)


@pytest.mark.parametrize("files", [0, 3])
def test_stream_of_a_table_in_one_file_or_a_folder(spark, tmp_path, files):
    import pandas as pd

    table = tmp_path / "talks.parquet"
    if files:
        table.mkdir()
    for i in range(files or 1):
        pd.DataFrame({"n": [i, i + 10]}).to_parquet(table / f"part-{i}.parquet" if files else table)
    (tmp_path / "other.parquet").mkdir()
    pd.DataFrame({"x": ["no row of talks"]}).to_parquet(tmp_path / "other.parquet" / "part-0.parquet")
    out = runner.drain(runner.stream_table(spark, str(tmp_path), "talks", 1), "talks")
    assert rows(out, "n", "batch_id") == sorted([(i + t, i) for i in range(files or 1) for t in (0, 10)], key=str)


def test_flags_on_arrival(spark, tmp_path):
    write_files(spark, tmp_path, READING, [[reading(1, 0, 250.0), reading(2, 0, 20.0), reading(3, 0, -100.0, "other")]])
    ranges = spark.createDataFrame([("m", -60.0, 150.0)], "metric_name string, min_value double, max_value double")
    stream = spark.readStream.schema(READING).parquet(str(tmp_path))
    out = runner.drain(telemetry.flagged(stream, ranges), "flags")
    assert rows(out, "id", "quality_flag") == [(1, "above_physical_range"), (2, None), (3, None)]
    assert quality.clean_readings(out).count() == 2


def test_rephrase_stream(spark, tmp_path):
    kind = "key string, id long, ts timestamp, ended timestamp, question string"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    first = [("s", 1, at(0), at(5), "why is V-042's range so low"), ("r", 4, at(0), None, "why is V-042's range so low")]
    second = [("s", 2, at(17), None, "Why did range drop on V-042?"), ("r", 5, at(45), None, "Why did range drop on V-042?")]
    write_files(spark, tmp_path, kind, [first, second])
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    assert rows(runner.drain(state.rephrased(stream), "rephrased"), "session_id", "turn_id", "gap_s") == [("s", 1, 12.0)]


def test_abandoned_starts_come_out(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    write_files(spark, tmp_path / "s", "key string, started timestamp", [[("a", at(0)), ("b", at(1)), ("z", at(300))]])
    write_files(spark, tmp_path / "e", "key string, ended timestamp", [[("a", at(2)), ("z", at(301))]])
    s = spark.readStream.schema("key string, started timestamp").parquet(str(tmp_path / "s"))
    e = spark.readStream.schema("key string, ended timestamp").parquet(str(tmp_path / "e"))
    out = runner.drain(state.paired(s, e), "paired")
    assert rows(out, "key", "ended") == [("a", at(2)), ("b", None), ("z", at(301))]


def test_document_stream(spark, tmp_path):
    kind = "doc_id long, raw string"
    write_files(spark, tmp_path, kind, [[(1, "one"), (2, "two"), (3, "two ")], [(1, "one"), (2, "two, changed"), (4, "four")]])
    path = session.shared_dir(spark, "ledger")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    runner.start(stream, documents.ingest_sink(path), "ledger").awaitTermination()
    log = spark.read.schema(documents.LOG).parquet(path)
    assert rows(log, "batch_id", "doc_id", "status") == [
        (0, 1, "ingested"), (0, 2, "ingested"), (0, 3, "skipped_duplicate"), (1, 1, "skipped_duplicate"), (1, 2, "replaced"), (1, 4, "ingested")]
    assert documents.stored(spark, path).count() == 3


def files_of(df):
    return {f.rsplit("/data/", 1)[1] for f in df.inputFiles()}


def test_ledger_reads_and_rewrites_touched_buckets_only(spark):
    path = session.shared_dir(spark, "ledger")
    sink = documents.ingest_sink(path, 60)
    kind = "doc_id long, raw string"
    for i in range(10):
        sink(spark.createDataFrame([(j, f"text {j}") for j in range(20 * i, 20 * i + 20)], kind), i)
    before = documents.ledger(spark, path)
    late = spark.createDataFrame([(7, "changed"), (9_000, "text 3")], kind)
    sink(late, 10)
    after = documents.ledger(spark, path)
    changed = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert len(changed) <= 3 and len(before.folders) > 50 and after.version == before.version + 1
    read = before.read(before.touched(documents.entries(late.selectExpr("doc_id", "sha2(raw, 256) AS content_hash"))))
    assert len(files_of(read)) <= 4 < 50 < len(files_of(before.read()))
    status = lambda: rows(spark.read.schema(documents.LOG).parquet(path).where("batch_id = 10"), "doc_id", "status")
    assert status() == [(7, "replaced"), (9000, "skipped_duplicate")]
    assert documents.stored(spark, path).count() == 200
    sink(late, 10)  # the batch runs again, after it was written
    assert status() == [(7, "replaced"), (9000, "skipped_duplicate")] and documents.ledger(spark, path).version == after.version
    sink(spark.createDataFrame([(600, "text 7"), (601, "changed")], kind), 11)
    assert rows(spark.read.schema(documents.LOG).parquet(path).where("batch_id = 11"), "doc_id", "status") == [(600, "ingested"), (601, "skipped_duplicate")]


def test_stored_rollup_rewrites_touched_hours_only(spark, tmp_path):
    import glob
    import os

    every = [reading(i, i / 3, float(i % 9)) for i in range(300)]
    late = [reading(1000 + i, h, 5.0) for i, h in enumerate((1.5, 1.7, 50.2, 51.1, 99.9))]
    everything = spark.createDataFrame(every + late, READING)
    path = str(tmp_path / "hours")
    rollup.store(rollup.hourly(everything.where("id < 1000")), path, "hour")
    stamp = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}
    before = stamp()
    cols = [*rollup.KEYS, "readings", "sum_value"]
    for _ in range(2):
        assert rollup.refresh_stored(everything, everything.where("id >= 1000"), path, "hour") == 4
        assert rows(rollup.stored(spark, path), *cols) == rows(rollup.hourly(everything), *cols)
    after = stamp()
    kept = {f for f in before if after.get(f) == before[f]}
    assert len({f.split("part=")[1][:10] for f in before}) == 100 and len({f.split("part=")[1][:10] for f in kept}) == 96
    assert rollup.refresh_stored(everything, everything.where("false"), path) == 0
    days = str(tmp_path / "days")
    rollup.store(rollup.hourly(everything.where("id < 1000")), days)
    assert rollup.refresh_stored(everything, everything.where("id >= 1000"), days) == 3
    assert rows(rollup.stored(spark, days), *cols) == rows(rollup.hourly(everything), *cols)


def test_late_rows_read_the_files_of_their_hours(spark, tmp_path):
    write_files(spark, tmp_path, READING, [[reading(i, d * 24 + i / 10, 1.0) for i in range(200)] for d in range(12)])
    readings = spark.read.parquet(str(tmp_path))
    hours = [T0 + dt.timedelta(hours=h) for h in (1, 2, 3, 200)]
    plan = readings.where(rollup._within(hours))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
    assert readings.where(rollup._within(hours)).count() == readings.where(F.date_trunc("hour", "recorded_at").isin(hours)).count() > 0


def test_scheduled_rollup_goes_on_where_it_ended(spark, tmp_path):
    import time

    write_files(spark, tmp_path / "in", READING, [[reading(i, i / 4) for i in range(40)]])
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(READING).parquet(str(tmp_path / "in"))
    q = telemetry.start_rollup(stream, out, "1 second")
    try:
        q.processAllAvailable()
        write_files(spark, tmp_path / "in", READING, [[reading(100 + i, 5 + i / 4) for i in range(40)]])
        time.sleep(1)
        q.processAllAvailable()
    finally:
        q.stop()
    got = telemetry.current_rollup(spark.read.option("basePath", out).parquet(out))
    cols = [*rollup.KEYS, "readings", "sum_value"]
    assert rows(got, *cols) == rows(rollup.hourly(spark.read.parquet(str(tmp_path / "in"))), *cols)


def test_shared_folder_comes_from_the_session():
    def cluster(folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder if k == "spark.checkpoint.dir" else d),
                               sparkContext=SimpleNamespace(master="spark://host:7077"))

    assert session.shared_dir(cluster("hdfs://shared/x/"), "t").startswith("hdfs://shared/x/t-")
    with pytest.raises(ValueError):
        session.shared_dir(cluster(None), "t")


@pytest.mark.parametrize("name", ["dp00_vehicle_vs_baseline", "ag07_hourly_rollup", "ag16_wilson_intervals", "dp25_untraceable_numbers", "dp16_batch_search"])
def test_query_equals_sql(spark, name):
    import glob
    import os

    import duckdb

    from fleetlens.plans import catalogue
    from tools.check import cell
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalogue.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    cur = db.execute(catalogue.ORACLES[name])
    have = [d[0] for d in cur.description]
    want = sorted(str(tuple(cell(r[have.index(c)]) for c in cols)) for r in cur.fetchall())
    assert sorted(str(tuple(cell(r[c]) for c in cols)) for r in df.collect()) == want and want
