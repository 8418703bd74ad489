"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line on stdout:
  {"metric": "...", "value": <sec>, "unit": "sec", "queries": {...}, "sf": ...}

Method: the warehouse load (staging -> dimensions with surrogate keys ->
fact) is timed once, cold; every query is then run once as warm-up and
three times measured (median kept), each time fully executed into the
``noop`` sink so nothing is collected on the driver.  ``value`` = load +
sum of query medians.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "bq1", "bq2", "bq3", "bq4", "bq5", "bq6", "bq7", "bq8", "bq9", "bq10", "bq11", "bq12", "bq13",
    "bqp1_genre_trend", "dq_log", "dq_log_dirty", "m_total_revenue", "m_avg_rev_per_film", "m_weekly_change",
    "m_kpi_actor", "h_calendar", "h_company", "p1_budget_tier_roi", "p3_decay_curve", "p4_country_share",
    "p6_top_actors", "e4_franchise", "c14_company_choice", "a7_cache_upsert", "i1_incremental_append",
    "b1_norm_title", "k10_match", "n_tier_labels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from marquee.plans import catalog, warehouse
    from marquee.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "8")), app="marquee-bench")
    spark.range(1).write.format("noop").mode("overwrite").save()  # JVM warm-up

    t0 = time.perf_counter()
    warehouse.load(spark, sf_dir)
    warehouse.load(spark, sf_dir, dirty=True)
    load = time.perf_counter() - t0
    print(f"load_warehouse {load:.2f}s", file=sys.stderr)

    times = {"load_warehouse": round(load, 3)}
    for key in only or HEADLINE:
        fn = catalog.QUERIES[key]
        runs = []
        for i in range(reps + 1):
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t)
        times[key] = round(statistics.median(runs), 3)
        print(f"{key:28s} {times[key]:.3f}s", file=sys.stderr)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "load_plus_sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
           "cpus": cpus, "reps": reps}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
