"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "anchor_first_event", "attrition_flow", "overlap_halfopen", "overlap_hours_agents", "treatment_classes", "landmark_effect",
    "two_clock_eligibility", "linkage_rules", "exists_flags", "sibling_components", "window_worst_by_concept", "lab_trajectory_features",
    "touched_days", "treatment_burden", "date_level_outcomes", "median_impute_flags", "item_summary", "clock_pair_offsets", "window_coverage",
    "keyword_hits", "iptw_logit", "balance_table", "weight_summary", "effect_matrix", "bootstrap_replicates", "bootstrap_strategies",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tideline.plans import catalog
    from tideline.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # Start the JVM, the code generator and the Python workers before the first measurement.
    for warm in ("landmark_effect", "iptw_logit"):
        catalog.QUERIES[warm].build(spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": scale}))


if __name__ == "__main__":
    main()
