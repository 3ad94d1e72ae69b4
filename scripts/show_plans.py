"""Print the physical plan of registered queries.

    python scripts/show_plans.py [sf_dir] name [name ...]

Shows ``explain("formatted")`` plus a one-line count of exchanges (shuffles),
broadcasts and scans, to check where a query moves data.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartwheel.plans.catalog import QUERIES  # noqa: E402
from cartwheel.session import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session()
    for name in args:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(p, plan)) for k, p in
                  (("exchanges", r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition"),
                   ("broadcasts", r"BroadcastExchange"), ("scans", r"FileScan|Scan ExistingRDD"))}
        print(f"===== {name}: {counts}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
