"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
Every query is run whole, from its input tables to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tallyloom.plans.queries import QUERIES  # noqa: E402
from tallyloom.session import build_session  # noqa: E402

HEADLINE = (
    "borda_leaderboard",
    "stored_results",
    "primary_metrics",
    "noul_diagnostics",
    "choice_adjusted",
    "score_adjusted",
    "box_metrics",
    "outcome_counts",
    "exploded_decisions",
    "first_cases",
    "check_prediction_keys",
    "order_total_ranks",
    "overlap_audit",
    "content_reuse",
    "scored_cases",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = 8 if cpus == "*" else max(int(cpus), 1)
    spark = build_session("bench", f"local[{cpus}]", partitions, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executors and the code cache; not part of any figure.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
