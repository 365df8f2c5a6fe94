"""Time the headline queries: warm median of three runs, one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_QUERIES (comma-separated
names, default the headline set, ``all`` for every query), BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

HEADLINE = [
    "unpivot_years", "pairwise_ratio", "nway_key_join", "left_enrich", "two_stage_rollup", "group_median", "weighted_mean",
    "share_of_total", "calendar_lag", "long_diff", "hhi_binned", "zone_rollup", "import_exposure", "median_series",
    "ols", "grouped_ols", "within_oneway", "within_twoway_unbalanced", "random_effects", "iv_2sls", "gmm_diff_onestep",
    "gmm_diff_twostep", "gmm_system", "first_diff_export", "change_table", "ols_study", "iv_study", "hc1_se", "durbin_watson_panel", "unit_root_fisher", "model_table",
]


def main() -> None:
    from panelweave.queries import QUERIES
    from panelweave.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        # The first run pays for code generation and cold files.
        times[name] = round(statistics.median(seconds[1:] or seconds), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": cpus,
                "runs": runs,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
