"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "dense_panel", "place_panel", "fact_nation_year", "pivot_conditional", "vintage_asof", "prior_in_group", "place_collapse", "radius_pairs", "nearest_site", "neighbour_sum", "catchment_enabled",
    "gravity_terms", "cost_to_serve", "cost_scenarios", "station_rollup", "cheapest_decile", "choice_topk", "conformal_sets", "auc", "calibration", "full_outer_presence", "glm_poisson", "p_median", "monte_carlo_bands", "portfolio_select", "portfolio_frontier", "white_space_race", "choice_fit", "hazard_cloglog", "facility_load", "facility_merge", "household_demand",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from gridfold.plans.catalog import QUERIES

    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # starts the engine
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
