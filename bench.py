"""Time the headline queries: BENCH_SF_DIR (tables), BENCH_CPUS (local cores); prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_alive_per_root", "h14_history_of_activity", "h14_history_of_parts", "h14_history_of_suppliers",
    "h9_directory_sizes", "h11_folder_changes", "h12_folder_versions", "h13_scan_statistics",
    "g3_asof_snapshot", "g3_asof_every_scan", "g8_previous_version", "b4_versions_domain", "e1_group_by",
    "f2_natural_path_order", "i3_hash_drift", "i8_issues_all_unreviewed", "i11_issue_summary",
    "i15_bulk_review_by_filter", "e10_duplicate_content", "j12_task_history", "k1_versions_from_changes",
    "k2_collapse_identical", "k7_rechain_overlaps", "k9_wrongly_deleted_folders", "k10_recount_statistics",
    "k10_recount_parts", "k14_folder_state_counts", "g4_containing_every_scan", "g11_below_every_folder", "s1_incremental_history",
)


def main() -> None:
    from pyspark.sql import SparkSession

    import catalog.all  # noqa: F401
    import catalog.scratch  # noqa: F401
    from catalog.base import QUERIES
    from tempora.sources import feeds

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    spark.range(1000).selectExpr("sum(id)").collect()
    timed("build_store", lambda: feeds.activity_store(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
