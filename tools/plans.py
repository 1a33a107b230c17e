"""List joins, exchanges and single-partition windows of every registered query's plan.

usage: python tools/plans.py [name or prefix ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.001"


def main() -> None:
    from tideline.plans import catalog
    from tideline.session import build_session

    spark = build_session(
        "plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name, q in catalog.QUERIES.items():
        if sys.argv[1:] and not any(name.startswith(n) for n in sys.argv[1:]):
            continue
        plan = q.build(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        ops = {
            k: len(re.findall(p, plan))
            for k, p in {
                "scan": r"FileScan", "exchange": r"Exchange hash", "single": r"Exchange SinglePartition", "bhj": r"BroadcastHashJoin",
                "smj": r"SortMergeJoin", "nested": r"NestedLoop|Cartesian", "python": r"MapInPandas|PythonMapIn",
                "window": r"\bWindow \[", "sort": r"TakeOrdered",
            }.items()
        }
        print(name, {k: v for k, v in ops.items() if v}, flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
