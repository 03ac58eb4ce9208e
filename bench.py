"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tripweave.plans.registry import QUERIES
from tripweave.session import local_session

HEADLINE = (
    "live_suggestions", "similar_suggestions", "similar_suggestions_batch", "walk_ball", "nearest_stop", "candidate_stops", "top5_ods", "compatible_requests", "related_requests",
    "path_requests", "travel_times_path", "path_cost", "earliest_times", "latest_times", "optimistic_schedule", "group_successive", "best_insertion", "fulfilment", "route_overlap",
    "grid_neighbour_counts", "mean_heading", "heading_discrepancy", "turn_penalty", "distance_matrix", "trigger_throttle",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["live_suggestions"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the executors' code
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
