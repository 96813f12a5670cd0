"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from rankintel.plans.catalog import queries
from rankintel.session import configure

HEADLINES = (
    "competitor_intel",
    "competitor_intel_per_query",
    "metal_breakdown_by_query",
    "serp_history",
    "position_trend",
    "delta_log",
    "detect_deltas",
    "snapshot_change_flags",
    "price_moves",
    "run_diffs",
    "build_snapshots",
    "upsert_replace",
    "competitor_products",
    "price_range",
    "html_to_text",
    "ranked_links",
    "marketplace_results",
    "listing_metadata",
    "jsonld_leaves",
    "classify_products",
)


def _run(query, spark: SparkSession, root: str) -> float:
    """Seconds from building the query to the last row."""
    start = time.perf_counter()
    query(spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankintel-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = sys.argv[1:] or HEADLINES
    # One untimed run so that the first query does not pay for the session's start.
    _run(registered[names[0]], spark, root)

    seconds = {}
    for name in names:
        seconds[name] = round(_run(registered[name], spark, root), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": root.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
