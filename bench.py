"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

HEADLINE = (
    "voxelize_mean", "kernel_relation", "subm_conv3d", "subm_conv3d_wide", "conv3d_strided", "conv_transpose3d_merging",
    "sum_pool3d", "max_pool3d", "knn", "radius_capped", "sparse_add", "morton_order", "devoxelize_linear", "topk_rows",
    "batch_norm", "mini_encoder", "downsample_block",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from gridstone.catalog import QUERIES

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, least = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        # the first run compiles code
        times[name], least[name] = round(median(runs[1:]), 3), round(min(runs), 3)
    out = {"metric": "sum of median seconds, headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "min": least, "sf": folder.rstrip("/").rpartition("sf")[2]}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
