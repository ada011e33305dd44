"""Tabulate the physical plan shape of every registered query on readings (after execution, AQE final plans).

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def global_windows(plan: str) -> int:
    n = 0
    for spec in re.findall(r"windowspecdefinition\(([^,)]*)", plan):
        s = spec.strip()
        if " ASC" in s or " DESC" in s or s.startswith("specifiedwindowframe"):
            n += 1
    return n


def shape(plan: str) -> dict:
    lines = plan.splitlines()

    def count(pat):
        return sum(1 for line in lines if re.search(pat, line))
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan)
    final = plan.split("== Initial Plan ==")[0]
    lines = final.splitlines()
    plan = final
    return {
        "shuffles": count(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin)"),
        "gathers": count(r"Exchange SinglePartition"),
        "reused": count(r"Reused(Exchange|Subquery)"),
        "bhj": count(r"BroadcastHashJoin"),
        "smj": count(r"SortMergeJoin"),
        "nlj": count(r"BroadcastNestedLoopJoin|CartesianProduct"),
        "windows": count(r"^\W*Window \["),
        "global_windows": global_windows(plan),
        "subqueries": count(r"^\W*Subquery subquery"),
        "python": count(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsIn|MapIn(Pandas|Arrow)"),
        "sort_agg": count(r"SortAggregate"),
        "columns_read": ";".join(sorted({str(len(c.split(","))) for c in scans})),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from wattspark.plans import registry
    from wattspark.session import get_session
    spark = get_session("local[8]", 8)
    cols = ["shuffles", "gathers", "reused", "bhj", "smj", "nlj", "windows", "global_windows", "subqueries",
            "python", "sort_agg", "columns_read"]
    print("# Physical plan shapes\n")
    print(f"Final adaptive plans of every registered query on readings at `{sf_dir}` (generated by `tools/plan_report.py`).")
    print("shuffles = hash/range exchanges, gathers = exchanges to one partition (final merge of a global")
    print("aggregate or the ordered window over daily rows), reused = reused exchanges/subqueries, bhj/smj/nlj =")
    print("broadcast-hash / sort-merge / nested-loop joins, global_windows = windows without a partition key,")
    print("columns_read = distinct widths (column counts) of the Parquet scans.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name, fn in registry.queries().items():
        df = fn(spark, sf_dir)
        df.collect()   # executes this DataFrame's own plan, so the AQE final plan is reported
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = shape(plan)
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
