"""Time the headline queries; one JSON line on standard output.

BENCH_SF_DIR and BENCH_CPUS choose data and cores. `etl` is the build of the
warehouse (star tables to stored fact); the other queries read it. Every query
runs once, cold, into a sink that discards rows.
"""

import json
import os
import sys
import time

from ledgerline.plans.registry import QUERIES
from ledgerline.session import build_session
from ledgerline.sources.warehouse import star_warehouse

# Everything but plain projections of stored tables; a12 and a13 are sums over what a11 makes.
HEADLINE = [
    n for n in QUERIES
    if not n.startswith(("s2_", "s3_", "s4_", "s5_", "m1_", "m2_", "m3_", "m4_", "m5_", "m6_", "m7_", "m8_", "m9_", "m10_", "m11_", "m12_", "m13_",
                         "m14_", "m15_", "m16_", "a12_", "a13_")) and not n.endswith("_filtered")
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="ledgerline-bench", spark__sql__shuffle__partitions=cpus)
    seconds = {}
    start = time.perf_counter()
    star_warehouse(spark, sf_dir).master  # noqa: B018  stores the fact
    seconds["etl"] = time.perf_counter() - start
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = time.perf_counter() - start
    print(json.dumps({
        "metric": "total wall-clock of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
