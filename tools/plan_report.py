"""Physical-plan facts per registered query, written as a markdown table.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
Streaming queries are skipped (their returned plan is a scan of the sink).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftwork.plans.registry import QUERIES, load_all  # noqa: E402
from siftwork.session import local_session  # noqa: E402


def facts(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "single_partition": "SinglePartition" in plan,
        "broadcasts": plan.count("BroadcastExchange"),
        "group_limit": "WindowGroupLimit" in plan,
        "top_k": "TakeOrderedAndProject" in plan,
        "python": bool(re.search(r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython", plan)),
        "pushed_filters": bool(re.search(r"PushedFilters: \[[^\]]+\]", plan)),
        "cartesian": "CartesianProduct" in plan,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    load_all()
    spark = local_session(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # report the static plan
    print("| query | shuffles | single-partition exchange | broadcasts | WindowGroupLimit | top-k | Python stage | pushed filters | cartesian |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        if name.startswith("stream_") or name == "json_roundtrip":
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        f = facts(plan)
        yn = lambda b: "yes" if b else ""
        print(f"| {name} | {f['shuffles']} | {yn(f['single_partition'])} | {f['broadcasts']} | {yn(f['group_limit'])} | "
              f"{yn(f['top_k'])} | {yn(f['python'])} | {yn(f['pushed_filters'])} | {yn(f['cartesian'])} |")


if __name__ == "__main__":
    main()
