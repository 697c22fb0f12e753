"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from framestride.plans.catalog import QUERIES
from framestride.session import drop_stages, local_session

HEADLINE = [
    "audit_episode_summary",
    "audit_score",
    "entity_motion",
    "temporal_metrics",
    "nearest_asof_sync",
    "phase_modes",
    "method_comparison",
    "grasp_hysteresis",
    "latch_propagation",
    "multi_view_triangulation",
    "interaction_tokens",
    "action_targets",
    "horizon_summary",
    "exact_duplicates_across_episodes",
    "experiment_leaderboard",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    # The JVM and the Python workers start outside the measurement.
    QUERIES["grasp_hysteresis"](spark, folder.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        drop_stages(spark)
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    rates = {
        n: round(rows / times[n])
        for n, rows in (("audit_episode_summary", events), ("nearest_asof_sync", events), ("horizon_summary", lines))
        if n in times
    }
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times,
                      "rows_per_sec": rates, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
