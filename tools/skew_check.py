"""Measure task skew of the neighbour lookup with one household holding half of all readings.

Runs a plain ``partitionBy(household)`` window, the bucketed lookup, and the
bucketed lookup with half of all readings on one household-*day* in separate Spark applications, each writing its event log to a fresh scratch
folder, and reports for each the largest number of shuffle records a single
task reads (``max_task_records``), next to the hot household's row count and
its number of distinct days (the bucketed lookup's boundary rows are at most
two per household-day). Prints one JSON line.

usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PARTITIONS = 16


def _hot_readings(spark, sf_dir):
    from pyspark.sql import functions as F
    from wattspark.sources.adapters import orders_readings
    r = orders_readings(spark, sf_dir)
    # half of all customers map to one household: the hot key
    hot = F.when(F.col("reading_id") % 2 == 0, F.lit("House_1")).otherwise(F.col("household_id"))
    return r.withColumn("household_id", hot)


def _hot_day(spark, sf_dir):
    """Half of all readings on one day of one household, and a tenth without a timestamp."""
    from pyspark.sql import functions as F
    r = _hot_readings(spark, sf_dir)
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("reading_id") * 7919 % 86400).cast("decimal(18,6)"))
    t = F.when(F.col("reading_id") % 2 == 0, F.to_timestamp_ntz(F.lit("1996-05-01")) + second) \
        .when(F.col("reading_id") % 10 != 1, F.col("timestamp"))
    return r.withColumn("timestamp", t)


def _run(mode: str, sf_dir: str) -> tuple[str, dict]:
    from pyspark.sql import SparkSession, Window
    from pyspark.sql import functions as F
    from wattspark.operators.neighbours import neighbour_values
    log_dir = tempfile.mkdtemp(prefix=f"wattspark-skew-{mode}-")
    spark = (SparkSession.builder.master("local[4]").appName(f"skew-{mode}")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", str(PARTITIONS))
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .getOrCreate())
    r = (_hot_day if mode == "hot_day" else _hot_readings)(spark, sf_dir)
    stats = r.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.col("household_id") == "House_1").alias("hot_rows"),
                  F.count_distinct(F.when(F.col("household_id") == "House_1", F.to_date("timestamp")))
                  .alias("hot_days")).first().asDict()
    if mode == "plain":
        w = Window.partitionBy("household_id").orderBy("timestamp", "reading_id")
        out = r.withColumn("prev_stage", F.coalesce(F.lag("load_shedding_stage").over(w), F.lit(0)))
    else:
        out = neighbour_values(r, "load_shedding_stage", prev_name="prev_stage", next_name="next_stage")
    out.write.format("noop").mode("overwrite").save()
    spark.stop()
    return log_dir, stats


def _max_task_records(log_dir: str) -> int:
    best = 0
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                    best = max(best, m.get("Total Records Read", 0))
    return best


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    res = {"partitions": PARTITIONS}
    for mode in ("plain", "bucketed", "hot_day"):
        log_dir, stats = _run(mode, sf_dir)
        if mode != "hot_day":
            res.update(stats)
        res[f"{mode}_max_task_records"] = _max_task_records(log_dir)
    print(json.dumps(res))


if __name__ == "__main__":
    main()
