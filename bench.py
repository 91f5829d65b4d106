"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from counterfold.plans.catalog import all_queries
from counterfold.session import local_session

HEADLINE = [
    "weighted_policy_values", "direct_and_doubly_robust", "more_robust_doubly_robust", "evaluated_policies",
    "bootstrap_over_rounds", "bootstrap_over_contexts", "exact_deterministic_value", "matching_permutation_test",
    "temporal_split", "temporal_split_with_ties", "exact_sample", "shared_item_index", "behaviour_scores",
    "enumerated_round_propensities", "greedy_mean_policy", "advantage_weighted_policy", "linear_bandit_policy",
    "bipartite_edges", "symmetric_edge_norms", "light_propagation", "edge_softmax", "held_out_ranking_loss",
    "qini_by_estimator", "running_reward_area", "effect_summary", "aggregated_cells", "claims_check",
    "streaming_estimates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    catalogue = all_queries()
    catalogue["exact_sample"].run(spark, sf_dir).count()  # start the JVM's code paths
    seconds = {}
    for name in only:
        start = time.perf_counter()
        catalogue[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf.group(1).rstrip("/.")) if sf else None,
    }))


if __name__ == "__main__":
    main()
