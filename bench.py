"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Each query runs to completion through a ``noop`` sink (every row computed,
nothing collected to the driver). Prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartwheel.plans.catalog import QUERIES  # noqa: E402
from cartwheel.session import build_session  # noqa: E402

HEADLINE = [
    "mba_top10",
    "graph_recs",
    "customer_cosine",
    "segment_recs",
    "feature_zscore",
    "als_explicit_recs",
    "purchase_graph",
    "customer_top_purchases",
    "recency_exclusion",
    "category_share_desc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", app="cartwheel-bench",
                          shuffle_partitions=max(8, 4 * cpus), driver_memory="24g")
    times, errors = {}, {}
    for name in names:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # report and go on: one failure must not hide the others
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total_wall",
           "value": round(sum(t for t in times.values() if t is not None), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
