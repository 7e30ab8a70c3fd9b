"""Gauges: hourly UTC flow, discovery, bundles, long series, fleet reports and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet import constants as K
from freshet.functions.text import pad_site_no
from freshet.operators import clean, joins, nearby, rollups, scenes, series, spatial
from freshet.operators.panels import daily_history
from freshet.operators.vectors import static_vectors


def usgs_to_hourly_utc(raw: DataFrame, key: str = "site_no", order: str = "ord") -> DataFrame:
    """Raw local-clock readings to numeric readings on full UTC hours."""
    flows = [c for c in K.FLOW_PARAMETERS.values() if c in raw.columns]
    hours = clean.local_to_utc(clean.top_of_local_hour(raw), key, "datetime", "tz_cd", order, codes_from=raw)
    return clean.coerce_numeric(hours, flows).select(key, order, F.col("datetime").alias("hour_updated"), *flows)


def discover_catchment(gauges: DataFrame, basins: DataFrame, weather_stations: DataFrame, soil_stations: DataFrame,
                       attributes: DataFrame | None = None, key: str = "site_no") -> DataFrame:
    """One row per gauge: basin box, nearest weather station of its state and best soil station."""
    boxes = spatial.basin_bbox(basins, key, 0.05).withColumn("basin_available", F.lit(True))
    nearest = nearby.nearest_station(gauges, weather_stations, on=["state_cd"], gauge_key=key).withColumnsRenamed(
        {"station_id": "asos_station_id", "distance_km": "asos_distance_km"})
    best = nearby.best_station(gauges, soil_stations, gauge_key=key).withColumnsRenamed(
        {"station_id": "scan_triplet", "distance_km": "scan_distance_km", "element_begin": "scan_sms_begin"})
    out = (gauges.join(boxes, key, "left").withColumn("basin_available", F.coalesce("basin_available", F.lit(False)))
           .join(nearest, key, "left").join(best, key, "left"))
    if attributes is None:
        return out
    flagged = joins.covered(out, attributes, key, "flag", "gages2_available")
    return flagged.join(attributes, key, "left")


def build_catchment_bundle(raw_flow: DataFrame, raw_weather: DataFrame, discovery: DataFrame,
                           soil: DataFrame | None = None, forcing: DataFrame | None = None,
                           start: str | None = None, end: str | None = None, key: str = "site_no") -> DataFrame:
    """Hourly bundle of all gauges for one window, each with its own weather and soil station."""
    flow = usgs_to_hourly_utc(raw_flow, key)
    weather = rollups.hourly_weather(raw_weather, ["station"], "ord" if "ord" in raw_weather.columns else None)
    if start is not None:
        flow, weather = (clean.time_range(t, "hour_updated", start, end) for t in (flow, weather))
    chosen = discovery.select(key, F.col("asos_station_id").alias("station"))
    weather = weather.join(chosen, "station").drop("station", "valid")
    if soil is not None:
        near = discovery.select(key, F.col("scan_triplet").alias("triplet"), F.col("scan_distance_km").alias("distance_km"))
        soil = soil.join(near, "triplet").drop("triplet")
    return joins.hourly_bundle(flow, weather, soil, forcing, key)


def long_term_series(chunks: Sequence[DataFrame], keys: Sequence[str] = ("site_no", "hour_updated"),
                     order: Sequence[str] = ("ord",)) -> DataFrame:
    """All chunks of all sites as one series without repeated hours."""
    return series.dedupe_concat(chunks, keys, order)


def long_term_summary(log: DataFrame, combined: DataFrame, key: str = "site_no") -> DataFrame:
    """Chunk counts of a run with each site's combined length and period."""
    length = combined.groupBy(key).agg(F.count(F.lit(1)).alias("combined_rows"), F.min("hour_updated").alias("start"),
                                       F.max("hour_updated").alias("end"))
    return rollups.run_summary(log, [key]).drop("combined_rows").join(length, key, "full")


def chunk_plan(periods: DataFrame, done: DataFrame, months: int = 12, key: str = "site_no") -> DataFrame:
    """Chunks of each site that have no output yet."""
    return series.calendar_chunks(periods, months).join(done, [key, "chunk_start"], "left_anti")


def fleet_report(registry: DataFrame, key: str = "site_no") -> DataFrame:
    """Count per status, and one row per failed site with its error."""
    counts = rollups.status_counts(registry).select(F.lit("count").alias("kind"), F.col("status").alias("name"),
                                                    F.col("n"), F.lit(None).cast("string").alias("error"))
    failed = registry.filter(F.col("status") == "failed").select(
        F.lit("failed").alias("kind"), F.col(key).alias("name"), F.lit(None).cast("bigint").alias("n"), "error")
    return counts.unionByName(failed)


def hydro_frame(flow: DataFrame, weather: DataFrame, preferences: DataFrame, snow: DataFrame, scene_rows: DataFrame,
                images: DataFrame, key: str = "site_no", block: Column | None = None,
                hours: DataFrame | None = None) -> DataFrame:
    """Flow with the first station that has data, then snow (filled), scenes and images of the hour.

    `preferences` lists stations per site by rank; flow is raw, weather is raw per station. `hours` is the flow of UTC
    hours where it is known already.
    """
    hours = usgs_to_hourly_utc(flow, key) if hours is None else hours
    folded = rollups.hourly_weather(weather, ["station"], "ord" if "ord" in weather.columns else None)
    chosen = joins.station_fallback(preferences, weather, key)
    joined = joins.weather_flow_inner(folded.join(chosen, "station"), hours, [key])
    snowed = joins.snow_left(joined, snow, [key])
    block = F.date_trunc("month", F.col("hour_updated")) if block is None else block
    filled = series.fill_nearest(snowed, [key], [F.col("hour_updated"), F.col("ord")], block, "snow_depth", "filled_snow")
    seen = joins.scene_left(filled, scene_rows, [key])
    # Scenes have multiplied the rows, which lie by site and hour already; dealing them anew would send them all again.
    return joins.images_left(seen, images, [key], list_bytes=None)


def enrich_gauge_meta(meta: DataFrame, raw_flow: DataFrame, weather: DataFrame, key: str = "site_no") -> DataFrame:
    """Clock code, flow range, missing counts and file name written back to gauge metadata.

    Gauges whose readings are missing keep their row with an error text.
    """
    ids = meta.withColumn(key, pad_site_no(F.col(key)))
    codes = raw_flow.groupBy(key).agg(F.min_by("tz_cd", "ord").alias("time_zone_code"))
    numeric = clean.coerce_numeric(raw_flow, ["cfs"])
    stats = rollups.flow_stats(numeric, [key]).drop("nan_flow")
    hours = usgs_to_hourly_utc(raw_flow, key)
    quality = rollups.join_quality(joins.weather_flow_inner(weather, hours, [key]), [key])
    out = ids.join(codes, key, "left").join(stats, key, "left").join(quality, key, "left")
    has = F.col("time_zone_code").isNotNull()
    return (out.withColumn("file", F.when(has, F.concat(F.col(key), F.col("station_id"), F.lit("_flow.csv"))))
            .withColumn("error", F.when(~has, F.lit("no readings"))))


def collect_gauge_record(gauges: DataFrame, attributes: DataFrame, days: DataFrame, scene_rows: DataFrame, start: str,
                         end: str, min_days: int = 1460, key: str = "site_no") -> DataFrame:
    """Embedding record of each gauge, or the first reason why it has none."""
    statics = static_vectors(attributes, key)
    history = daily_history(days, start, end, min_days, key).drop("status")
    scene = scenes.scene_status(gauges, scene_rows, key).withColumnRenamed("status", "scene_status")
    full = (gauges.join(statics, key, "left").join(history, key, "left").join(scene, key, "left")
            .withColumn("history_days", F.coalesce("history_days", F.lit(0))))
    status = (F.when(F.col("static").isNull(), "no_gages2").when(F.col("history_days") < min_days, "short_history")
              .otherwise(F.col("scene_status")))
    full = full.withColumn("status", status).drop("scene_status")
    ok = F.col("status") == "ok"
    return full.withColumns({c: F.when(ok, F.col(c)) for c in ("static", "history", "product_id", "cloud_percent")})
