"""Headline queries on one machine: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimlens.plans import catalog  # noqa: E402
from claimlens.plans.session import local_session  # noqa: E402

HEADLINE = ["A1", "A6", "A7", "A11", "F2", "F18", "W1", "T1", "T3", "T4", "J1", "J2", "J5", "P2", "P3", "P8", "L1", "L5", "V3", "V4", "V6", "S12", "E4", "E7"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores)
    queries, _ = catalog.load()
    queries["A15"](spark, folder).write.format("noop").mode("overwrite").save()  # start the engine
    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "claimlens_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": cores}))


if __name__ == "__main__":
    main()
