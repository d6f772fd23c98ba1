"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_out_of_time", "lagged_horizon_frame", "dedup_keep_first", "pivot_fixed_columns", "forward_event_label", "trajectory_features", "out_of_time_splits",
    "country_preserving_folds", "out_of_fold_encoding", "winsor_squash", "rank_metrics", "score_card", "row_hash_containment", "nearest_context", "session_event_windows",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from panelforge import plans

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    taken = {}
    for name in HEADLINE:
        began = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
