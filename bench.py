"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then three times; the median wall time is
reported.  A run executes the whole plan with the no-op sink (no collect).
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "contact_run",        # P1: collate -> suppress -> dial limits -> clean -> 66 cols -> dedup
    "rechurn_run",        # P2: extract -> suppress -> limits -> snapshot merge -> output
    "dial_limit_tag",     # A1/A1b: dial counts over the history week + limit rule
    "history_ingest",     # K1: in-batch dedup + semi/anti join against the store
    "audit_rows",         # K3: per-row audit with JSON payload
    "snapshot_lookup",    # J7: latest-batch lookup by (campaign, link)
    "rechurn_filter",     # FL3: keyword filter over the call log
    "output_dedup",       # W1: keep-first over the overlapping contact files
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from dialsieve.plans.catalog import QUERIES
    from dialsieve.session import build_session
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in HEADLINE:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "repeats": repeats,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
