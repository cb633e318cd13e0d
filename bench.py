"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints ONE JSON line.  Each query is executed in
full through the ``noop`` sink (no driver collect); one warm-up run, then the
median of ``$BENCH_REPEAT`` (default 1) timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripwire.plans.queries import QUERIES  # noqa: E402
from tripwire.session import get_spark  # noqa: E402

HEADLINE = ["scan_verdicts", "document_verdicts", "scan_findings", "tx_precheck", "daily_running_spend",
            "daily_accepted_spend", "policy_asof", "allowlist_asof", "gate_outcomes"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times: dict[str, float] = {}
    for name in HEADLINE:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up (JIT, plan caches)
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
