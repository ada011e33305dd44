"""A household holding more than half of the readings does not land in one task (event-log measurement)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_hot_household_is_split_across_tasks():
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "skew_check.py"), "/root/testdata/sf0.1"],
                         capture_output=True, text=True, timeout=900, cwd=ROOT)
    line = [x for x in out.stdout.splitlines() if x.startswith("{")][-1]
    res = json.loads(line)
    assert res["hot_rows"] > res["rows"] / 2
    assert res["plain_max_task_records"] >= res["hot_rows"]            # the plain window: one task per household
    assert res["bucketed_max_task_records"] <= 0.25 * res["hot_rows"]  # bucketed: spread over tasks
    # half the rows on one household-day, a tenth without a timestamp: below twice the mean task
    assert res["hot_day_max_task_records"] <= 2 * res["rows"] / res["partitions"]
