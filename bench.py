"""Timed headline queries: one JSON line on stdout.

The first group starts from an empty workspace for every query. The review group starts from one
empty workspace: its first query pays for catalog, expansion and coverage tables, the others are
the reports of that same review, as in a real run.
"""

import json
import os
import time

from ripplemap.bridge import QUERIES
from ripplemap.bridge.registry import workspace
from ripplemap.plans.session import local_session

ALONE = [
    "t7_dim_customers",
    "t8_fct_orders",
    "t9_fct_revenue",
    "t10_customer_ltv",
    "t13_seeded_share",
    "s1_urn_harvest",
    "c8_visible_edges",
    "d8_changes",
    "m4_rewrite_words",
    "q4_paths_between",
    "g8_closure_cube",
]
REVIEW = [
    "v5_coverage_score",
    "g5_rooted_subgraph",
    "i9_ceiling",
    "i5_explanations",
    "m7_fix_counts",
    "x2_decision_bodies",
    "p4_review_documents",
    "e3_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores))
    spark.read.parquet(f"{folder}/events.parquet").count()
    times: dict[str, float] = {}
    for name in ALONE + REVIEW:
        if name in ALONE or name == REVIEW[0]:
            workspace(spark, folder, fresh=True)
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
