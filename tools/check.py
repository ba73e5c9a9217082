"""Run queries against their DuckDB oracles locally (twin of the driver's gate).

usage: python tools/check.py [--sf DIR] [key-prefix ...]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    from ferryman.plans import registry
    from ferryman.plans.check import compare, duck_connect
    from ferryman.session import get_spark

    spark = get_spark("local[8]")
    qs, sqls = registry.queries(), registry.oracle_sql()
    con = duck_connect(a.sf)
    bad = 0
    for k in sorted(qs):
        if a.keys and not any(k.startswith(p) for p in a.keys):
            continue
        t0 = time.time()
        try:
            r = compare(spark, k, qs[k], sqls.get(k), a.sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "status": "error", "error": str(e).splitlines()[0][:300]}
        r["sec"] = round(time.time() - t0, 2)
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(json.dumps(r, default=str)[:1500], flush=True)
    print(f"# {bad} not ok", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
