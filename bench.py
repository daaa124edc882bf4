"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens import session  # noqa: E402
from fleetlens.plans import catalogue  # noqa: E402

HEADLINE = [
    "dp00_vehicle_vs_baseline", "pf08_quality_flags", "pf09_clean_guard", "pf10_reflag_changed", "ag07_hourly_rollup", "ag09_weekly_buckets",
    "ag03_percentiles", "ag12_since_onset", "w01_ranks", "w02_lag_lead", "w04_latest_reading", "w11_rolling_usage", "w12_failure_streaks",
    "dp39_fleet_report", "ag01_group_by", "ag15_grouping_sets", "j10_sales_by_period", "ag36_period_change", "j18_orphan_audit",
    "sf10_content_hash", "dp01_ingest_status", "w07_last_occurrence", "dp04_chunks", "dp37_cleaned_pages", "ud07_page_text", "dp30_leaked_terms",
    "j15_nearest_vectors", "dp11_sparse_candidates", "dp16_batch_search", "ag25_threshold_sweep", "dp17_resolved_ids", "dp17_misspelled_ids",
    "j14_near_duplicates", "dp18_rephrased_turns", "dp20_failure_signatures", "tk07_review_queue", "ag26_cluster_status", "dp25_untraceable_numbers",
    "dp28_answer_checks", "ag16_wilson_intervals", "ag18_agreement", "j07_run_diff", "dp35_report", "ag32_latency_quantile", "ag34_call_costs",
    "st02_hourly_stream", "st05_late_rows", "st10_sliding_ratio", "st16_compacted_weeks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session.build("bench", f"local[{cpus}]", cpus, {
        "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # One query of each kind first, so that the JVM and the Python workers are warm.
    for name in ("ag01_group_by", "ud05_fuzzy_scores"):
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
