"""Time the headline queries and print one JSON line.

Every query is executed in full into the ``noop`` sink. The derived input tables are landed
before the clock starts, like the tables at rest they stand for.
"""

from __future__ import annotations

import json
import os
import sys
import time

import prefloom.catalog.all  # noqa: F401
from prefloom.catalog.registry import QUERIES
from prefloom.session import build_session
from prefloom.sources.derived import LANDED, Inputs

HEADLINE = (
    "f1_leaderboard", "f3_next_to_rate", "d1_library_stats", "d4_match_counts", "h3_elo_replay", "e10_quantile_anchors",
    "h7_next_pair", "a2_feedback_window", "e3_mixed_participant_window", "h4_idempotent_ratings", "c15_purged_issuances",
    "e6_image_disjoint_split", "c4_reward_attribution", "i2_exp3_log_weights", "i3_behaviour", "b1_rejection_reason",
    "c9_first_seen_in_run", "f10_admitted_candidates", "f11_round_robin", "c10_near_library", "c11_greedy_distinct",
    "b6_edge_energy", "b7_html_to_text", "b9_redacted_text", "c5_pair_features", "d8_ordinal_metrics", "i7_utility_scores",
    "i11_joint_fit", "i11_user_models", "i17_library_scores", "i20_training_decision", "i21_job_health", "k2_answered_issuances",
    "k4_running_elo", "k8_hourly_activity", "l3_orphans", "i12_threshold_calibration", "i13_bootstrap_scores", "i15_training_run",
    "i16_encoded_documents", "a5_provider_candidates", "e8_byte_budget_skipping",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(1, int(cpus) if cpus.isdigit() else 8))
    inputs = Inputs(spark, path)
    start = time.perf_counter()
    for view in LANDED:
        inputs.view(view).schema  # lands the view
    landing = round(time.perf_counter() - start, 3)
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "landing": landing, "queries": times, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
