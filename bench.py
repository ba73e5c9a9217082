"""Benchmark: run the registered queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is forced end to end with the ``noop`` sink (full execution, no
collect to the driver). One warm-up run, then the median of ``$BENCH_RUNS``
timed runs per key. Prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8),
     BENCH_RUNS (3), BENCH_QUERIES (comma list of keys; default all).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]

    from ferryman.plans import registry
    from ferryman.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2, app="ferryman-bench")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    qs = registry.queries()
    keys = [k for k in sorted(qs) if not only or k in only]

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for k in keys:
        try:
            samples = []
            for i in range(runs + 1):
                t0 = time.perf_counter()
                qs[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                if i > 0:           # first run is the warm-up
                    samples.append(dt)
            times[k] = round(statistics.median(samples), 4)
        except Exception as e:  # keep benchmarking the rest
            failed[k] = str(e).splitlines()[0][:200]
        print(f"# {k}: {times.get(k, 'FAILED')}", file=sys.stderr, flush=True)

    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "runs": runs,
        "cpus": cpus,
        "n_queries": len(times),
        "spark": spark.version,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
