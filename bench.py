"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once cold and is timed on a second run with all caches cleared.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "supplier_profile",
    "active_tenders",
    "buyer_activity",
    "tfidf_terms",
    "interaction_matrix",
    "scaling_parameters",
    "silhouette_gower",
    "gower_medoid_assign",
    "analyze_supplier",
    "ranked_opportunities",
    "kmedoids",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tenderloom.plans import runner
    from tenderloom.session import local_session

    spark = local_session(cores, "bench")
    timings = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        for _ in range(2):
            spark.catalog.clearCache()
            start = time.time()
            runner(name)(spark, folder).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
