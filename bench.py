"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import time

from courtflow.plans import QUERIES
from courtflow.session import local_session

HEADLINE = [
    "flight_windows",
    "shot_candidates",
    "board_crashes",
    "shot_report",
    "shot_probability",
    "audit_disagreements",
    "label_patch",
    "pair_overlap",
    "ghost_tracks",
    "pose_player_match",
    "spike_reject",
    "gap_fill",
    "kalman_smooth",
    "ball_validate",
    "team_rolling_vote",
    "jersey_lock",
    "pe_metrics",
    "peak_centroid",
    "src_tracking_json",
    "stream_kalman",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # the first query of a session pays for class loading; it is not one of the timed ones
    QUERIES["label_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )


if __name__ == "__main__":
    main()
