"""Time the headline queries: one JSON line on standard output.

`BENCH_SF_DIR` is the table folder (default sf0.1), `BENCH_CPUS` the number of local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from haulgrid.plans.catalog import QUERIES

HEADLINE = [
    "total_by_year", "panel_unpivot", "forecast_pivot", "dense_site_index", "matrix_to_edges", "two_hop_arcs", "least_two_hop_arcs",
    "arcs_within", "radius_edges", "nearest_cell", "neighbour_spacing", "k_nearest", "catchment_sum", "catchment_curve",
    "describe_measure", "correlation_matrix", "histogram", "pareto_share", "balanced_blocks", "cluster_profile",
    "weather_flatten", "weather_daily_hourly", "fill_single_depot", "choose_one_depot", "transport_cost", "total_cost",
    "solution_to_submission", "audit", "kmeans_sites", "average_linkage", "open_depots", "open_depots_by_cluster",
    "plan_status", "plan_improvement", "open_refineries", "refinery_direct", "allocation_bound", "supply_chain_plan", "read_distance_matrix", "read_submission",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["total_by_year"](spark, sf).collect()  # start-up is not a query
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
