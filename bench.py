"""Seconds per headline query, as one JSON line.

Every query runs to the end (a no-op sink takes all rows) on local[$BENCH_CPUS] against
$BENCH_SF_DIR.  BENCH_QUERIES (comma-separated) narrows the list while working on one query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from gridloom.queries import QUERIES  # noqa: E402
from gridloom.session import build_session  # noqa: E402

HEADLINE = [
    "noon_filter",
    "region_crop",
    "divisible_crop",
    "reindex_coarse_to_fine",
    "regrid_linear",
    "regrid_with_gaps",
    "combine_static_features",
    "standardized_anomalies_fine",
    "min_max_temperature",
    "denormalized_dataset",
    "split_labels",
    "batches_shuffled",
    "metric_bundle",
    "comparison_histograms",
    "difference_map",
    "cell_regression_prediction",
    "block_max_pool",
    "focal_convolution",
    "upsample_bilinear",
    "tile_round_trip",
    "dataset_round_trip",
    "daily_anomalies",
    "daily_regrid",
    "daily_regrid_metrics",
    "daily_focal",
    "daily_split",
    "experiment_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    picked = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(
        "gridloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in picked:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)", sf_dir)
    result = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(found.group(1)) if found else sf_dir,
        "spark": spark.version,
        "cpus": int(cpus),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
