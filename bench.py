"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and fully executed into the ``noop`` sink (no collect),
after a warm-up on the smallest scale that starts the JVM and Python workers.
The figure is the median of three runs, or the only run where the first takes
over SLOW seconds.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vireo.plans import registry  # noqa: E402
from vireo.session import get_spark  # noqa: E402

HEADLINE = [
    "eval_sweep", "ndcg_at_k", "ap_classic", "rank_lists", "mrr_mean", "cosine_top_k", "sample_one", "feature_neighbors",
    "response_validate", "roi_explode", "dataset_profile", "rmse_all_denominator", "mean_baseline_rmse", "top_n_with_titles",
    "best_config", "batch_inference_top_k", "batch_inference_map", "batch_rows", "als_explicit_holdout", "als_grid_search",
    "als_implicit", "sweep_mlp",
]
RUNS, SLOW = 3, 15


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_spark(f"local[{cpus}]", app="vireo-bench", shuffle_partitions=cpus,
                      extra={"spark.driver.memory": "16g"})
    qs = registry.queries()
    # warm-up on the smallest scale (JVM class loading, JIT, Python workers);
    # not timed
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in only or [q for q in HEADLINE if q != "sweep_mlp"]:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in only or HEADLINE:
        runs = []
        while len(runs) < RUNS and not (runs and runs[0] > SLOW):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
