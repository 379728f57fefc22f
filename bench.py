"""Time the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = ["flagship", "c01_duplicates", "c03_near_any", "c04_held", "d04_forest_counts", "e02_ranked", "f06_group_by_tag", "f07_count_by_fields", "f08_bins_by_count", "f12_day", "f14_bounds", "g01_pivot", "g05_kruskal", "j01_set", "j05_list_set", "j06_merge", "k01_between", "k02_apply", "c11_three_way", "g16_vector_search", "f15_components", "c05_neighbours", "c15_some", "c07_table", "m04_feed", "i15_max_spacing"]


def main() -> None:
    from pyspark.sql import SparkSession

    from terravane.plans import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    d = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", d)
        .config("spark.checkpoint.dir", f"file://{d}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalog.queries(), {}
    known["flagship"](spark, sf).write.format("noop").mode("overwrite").save()  # warm up
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
