"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS timed runs after one warm-up run (default 1; the median is kept).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from spanframe.plans.catalog import REGISTRY
from spanframe.plans.registry import Tables
from spanframe.session import local_session

HEADLINE = [
    "merge_intervals", "overlap_pairs", "subtract", "overlaps_any", "points_in_any_region", "points_with_features", "overlap_metrics",
    "pairwise_matrices", "consensus_regions", "annotate_with_sources", "region_context", "region_mean",
    "collapse_duplicates", "region_features", "region_resolution", "point_confusion", "nearest_feature",
    "association_scores", "tag_intervals", "context_features", "states_to_regions", "group_kfold", "permute_null",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_ONLY")
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    times = {}
    for name in only.split(",") if only else HEADLINE:
        taken = []
        for i in range(runs + 1):
            began = time.perf_counter()
            REGISTRY[name].run(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
