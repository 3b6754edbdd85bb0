"""Times the headline queries: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from pyrelake.plans.queries import QUERIES

HEADLINE = ("stats_kpi", "stats_by_province", "public_stats_monthly", "trend_projection", "recurrence_live", "recurrence_view", "episode_metrics", "quality_scores", "legal_crossing", "audit_prohibition", "ingest_dedup", "stdbscan_labels", "stdbscan_events", "daily_dbscan_events", "consolidate_events", "recovery_series", "redact_pii")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["stats_by_province"](spark, sf).write.format("noop").mode("overwrite").save()  # warm up: session and file listing
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
