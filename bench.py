"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

All queries run once to warm up, then BENCH_RUNS times each (default 3); the
median wall time counts. Results are forced through the no-op sink, so every
row and column is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from scopeledger.catalog import QUERIES
from scopeledger.session import build_session

HEADLINE = [
    "q01_monthly_trend", "q02_year_over_year_full_history", "q03_scope3_pareto", "q04_target_progress",
    "q05_facility_intensity", "q06_region_type_subtotals", "q07_quality_audit", "q08_decomposition",
    "q09_renewable_impact", "q10_reduction_opportunities", "v01_monthly_totals", "v03_facility_rankings",
    "x05_monthly_summary", "s03_load_combined", "k01_summary_kpis", "k08_intensity_trend", "k19_scorecard",
    "d02_failed_rule_summary", "g04_facility_allocation", "r02_npv", "r10_site_portfolios",
    "f04_holt_winters_damped_by_facility", "f11_scenario_comparison",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        timed(spark, name, sf_dir)
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
