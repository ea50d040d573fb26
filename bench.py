"""Headline queries, timed: one JSON line on stdout.

Each query runs to completion without collecting its rows (``noop`` sink); the better of two runs
counts, so that start-up and code generation of the first run are not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite import QUERIES  # noqa: E402
from tidemark.session import clean_scratch, local_session  # noqa: E402

HEADLINE = [
    "pollution1",
    "pollution1_sliding",
    "pollution2",
    "pollution3",
    "harass_max",
    "hourly_max",
    "discretize_tumbling",
    "discretize_sliding",
    "minus",
    "be_subset",
    "failing_examples",
    "window_head",
    "letters_zip",
    "t_always",
    "t_until",
    "t_nested",
    "bound_alert_liveness",
    "case_verdict",
    "prop_high_never_ok",
    "prop_high_eventually_alert",
    "prop_single_hourly_max",
    "stream_pollution1",
    "stream_record_evaluate",
]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    result = {
        "metric": "headline queries, total wall-clock",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    clean_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
