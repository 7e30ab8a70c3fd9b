"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores, BENCH_QUERIES a comma-separated choice
(or `all`).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "weather_flow_inner", "hourly_weather", "local_to_utc", "usgs_to_hourly_utc", "hourly_resample", "images_per_hour",
    "period_of_record", "daily_temp_pet", "hourly_bundle", "merge_series_outer", "static_matrix", "bbox_join", "polygon_join",
    "nearest_station", "best_station", "k_nearest_stations", "basin_mean_mask", "band_means", "snow_profile_fit", "dem_sample_nn",
    "fill_nearest", "rolling_coverage", "rolling_log_mean", "season_topk", "drought_slice", "select_panel", "panel_slices", "build_panels",
    "select_panel_hours", "panel_slices_hours", "daily_history", "clearest_scene", "dedupe_concat", "thin_by_gap", "calendar_chunks", "incremental_delta", "pending_work",
    "camera_pattern_match", "cosine_neighbours", "discover_catchment", "build_catchment_bundle", "long_term_series", "hydro_frame",
    "basin_swe_series", "snow_state", "collect_gauge_record", "read_rdb_iv", "snow_tars_to_cells", "write_hourly",
]


def main() -> None:
    from freshet import build_session
    from freshet.catalog import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(max(8, int(cpus))), "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
