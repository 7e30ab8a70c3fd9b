"""Queries of whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.catalog.aggregates import BASIN_CELLS, BASINS, IMAGES, _SWE, basins, camera_images, dated_cells, snow_cells
from freshet.catalog.frames import flow_hourly, weather_site
from freshet.catalog.linking import DEM_SQL, KM, SCENE_TIMES, SNOW, daily_snow, sensed_scenes, soil_forcing, terrain
from freshet.catalog.registry import Inputs, query, rounded, stamp
from freshet.catalog.views import FLOW, JOINED
from freshet.catalog.windows import CHUNKS, CLEAREST, periods
from freshet.operators import rollups, spatial
from freshet.plans import catchments, snow
from freshet.session import stored


@query("usgs_to_hourly_utc", "SELECT site_no, ord, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, cfs FROM flow_hourly", FLOW)
def usgs_to_hourly_utc(d: Inputs) -> DataFrame:
    return flow_hourly(d).select("site_no", "ord", stamp("hour_updated").alias("hour_updated"), "cfs")


NEAREST = f"""near AS (SELECT * FROM (SELECT g.site_no, t.station_id, {KM} AS km, row_number() OVER (PARTITION BY g.site_no ORDER BY {KM}, t.ord) AS k
  FROM gauges g JOIN stations t ON g.state_cd = t.state_cd) WHERE k = 1),
best AS (SELECT * FROM (SELECT g.site_no, t.station_id, t.begin_date, {KM} AS km, row_number() OVER (PARTITION BY g.site_no ORDER BY t.begin_date, {KM}, t.ord) AS k
  FROM gauges g, stations t WHERE {KM} <= 75) WHERE k = 1)"""


def discovery(d: Inputs) -> DataFrame:
    gauges, stations = d.view("gauges"), d.view("stations")
    attributes = d.table("part").filter(F.col("p_partkey") % 2 == 0).select(
        F.lpad((F.col("p_partkey") + 10000000).cast("string"), 8, "0").alias("site_no"), F.col("p_size").alias("gages2_slope"))
    return catchments.discover_catchment(gauges, basins(d), stations, stations, attributes)


@query("discover_catchment", f"""WITH {NEAREST}
SELECT g.site_no, g.station_nm, n.station_id AS asos_station_id, n.km AS asos_distance_km, b.station_id AS scan_triplet, b.km AS scan_distance_km, b.begin_date AS scan_sms_begin,
  g.site_no IN ({BASINS}) AS basin_available, p.p_partkey IS NOT NULL AS gages2_available, p.p_size AS gages2_slope
FROM gauges g LEFT JOIN near n USING (site_no) LEFT JOIN best b USING (site_no)
LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) p ON p.p_partkey + 10000000 = CAST(g.site_no AS BIGINT)""", ["gauges", "stations"])
def discover_catchment(d: Inputs) -> DataFrame:
    return discovery(d).select("site_no", "station_nm", "asos_station_id", "asos_distance_km", "scan_triplet", "scan_distance_km", "scan_sms_begin",
                               "basin_available", "gages2_available", "gages2_slope")


@query("build_catchment_bundle", """
WITH s AS (SELECT site_no, hour_updated, min(ord) AS sms FROM flow_hourly GROUP BY 1, 2),
k AS (SELECT site_no, hour_updated, ord, cfs FROM flow_hourly WHERE hour_updated BETWEEN TIMESTAMP '2024-10-20' AND TIMESTAMP '2024-11-10 12:00:00')
SELECT site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, k.ord, k.cfs, round(w.p01m, 6) AS p01m, round(w.tmpf, 6) AS tmpf,
  CASE WHEN CAST(site_no AS BIGINT) % 4 * 30 <= 75 THEN s.sms END AS sms
FROM k LEFT JOIN weather_site w USING (site_no, hour_updated) LEFT JOIN s USING (site_no, hour_updated)""", JOINED[:-1])
def build_catchment_bundle(d: Inputs) -> DataFrame:
    raw = d.view("iv_raw")
    sites = raw.select("site_no").distinct()
    number = F.col("site_no").cast("bigint")
    found = sites.select("site_no", F.concat(F.lit("K"), F.lpad((number - 10000000).cast("string"), 3, "0")).alias("asos_station_id"),
                         F.col("site_no").alias("scan_triplet"), (number % 4 * 30).cast("double").alias("scan_distance_km"))
    soil = soil_forcing(flow_hourly(d))[0].drop("distance_km").withColumnRenamed("site_no", "triplet")
    out = catchments.build_catchment_bundle(raw, d.view("asos_fall"), found, soil, start="2024-10-20", end="2024-11-10 12:00:00")
    return out.select("site_no", stamp("hour_updated").alias("hour_updated"), "ord", "cfs", *rounded("p01m", "tmpf"), "sms")


@query("long_term_series", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY site_no, hour_updated ORDER BY ord % 3, ord) AS k FROM flow_hourly), one AS (SELECT * FROM r WHERE k = 1)
SELECT site_no, count(*) AS combined_rows, strftime(min(hour_updated), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(hour_updated), '%Y-%m-%d %H:%M:%S') AS "end",
  any_value(l.f) AS chunks_fetched, any_value(l.s) AS chunks_skipped, any_value(l.x) AS chunk_failures, round(sum(cfs), 6) AS cfs
FROM one JOIN (SELECT lpad(CAST(10000000 + o_custkey % 12 AS STRING), 8, '0') AS site_no, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS s,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS x FROM orders GROUP BY 1) l USING (site_no) GROUP BY site_no""", FLOW)
def long_term_series(d: Inputs) -> DataFrame:
    flow = flow_hourly(d)
    chunks = [flow.filter(F.col("ord") % 3 == i) for i in range(3)]
    whole = catchments.long_term_series(chunks)
    named = F.create_map(*[F.lit(x) for x in ("F", "fetched", "O", "skipped", "P", "failed")])
    log = d.table("orders").select(F.lpad((F.col("o_custkey") % 12 + 10000000).cast("string"), 8, "0").alias("site_no"), named[F.col("o_orderstatus")].alias("status"), F.lit(0).alias("rows"))
    summary = catchments.long_term_summary(log, whole)
    flows = whole.groupBy("site_no").agg(F.round(F.sum("cfs"), 6).alias("cfs"))
    return summary.join(flows, "site_no").select("site_no", "combined_rows", stamp("start").alias("start"), stamp("end").alias("end"), "chunks_fetched", "chunks_skipped", "chunk_failures", "cfs")


@query("chunk_plan", f"""WITH {CHUNKS}
SELECT o_custkey, strftime(s, '%Y-%m-%d') AS chunk_start FROM c WHERE (o_custkey, s) NOT IN (SELECT (o_custkey, s) FROM c WHERE month(s) % 2 = 0)""")
def chunk_plan(d: Inputs) -> DataFrame:
    from freshet.operators import series

    span = periods(d)
    done = series.calendar_chunks(span, 6).filter(F.month("chunk_start") % 2 == 0).select("o_custkey", "chunk_start")
    return catchments.chunk_plan(span, done, 6, "o_custkey").select("o_custkey", F.col("chunk_start").cast("string").alias("chunk_start"))


@query("fleet_report", """
SELECT 'count' AS kind, status AS name, count(*) AS n, NULL AS error FROM registry GROUP BY status
UNION ALL SELECT 'failed', site_no, NULL, 'state ' || CAST(state AS STRING) FROM registry WHERE status = 'failed'""", ["registry"])
def fleet_report(d: Inputs) -> DataFrame:
    return catchments.fleet_report(d.view("registry").withColumn("error", F.concat(F.lit("state "), F.col("state").cast("string"))))


HYDRO = f"""pref AS (SELECT site_no, arg_min(station, rank) AS station FROM (SELECT site_no, r AS rank, 'K' || lpad(CAST((CAST(site_no AS BIGINT) * 7 + r * 13) % 40 AS STRING), 3, '0') AS station
  FROM (SELECT DISTINCT site_no FROM iv_raw), range(5) t(r)) WHERE station IN (SELECT station FROM asos_fall) GROUP BY site_no),
j AS (SELECT f.site_no, f.hour_updated, f.ord, f.cfs, w.p01m, w.station FROM weather_hourly w JOIN pref p USING (station) JOIN flow_hourly f ON f.site_no = p.site_no AND f.hour_updated = w.hour_updated),
snow AS ({SNOW}), s AS (SELECT j.*, snow_depth FROM j LEFT JOIN snow ON snow.site_no = j.site_no AND CAST(snow.day AS TIMESTAMP) = j.hour_updated),
p AS (SELECT *, row_number() OVER w AS pos, last_value(snow_depth IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bv,
  first_value(snow_depth IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av FROM s WINDOW w AS (PARTITION BY site_no ORDER BY hour_updated, ord)),
q AS (SELECT *, last_value(CASE WHEN snow_depth IS NOT NULL THEN pos END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bp,
  first_value(CASE WHEN snow_depth IS NOT NULL THEN pos END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ap FROM p WINDOW w AS (PARTITION BY site_no ORDER BY pos)),
sc AS (SELECT site_no, scene, make_timestamp(CAST(round_even(epoch_us(sensed) / 3.6e9, 0) AS BIGINT) * 3600000000) AS hour_updated FROM ({SCENE_TIMES})),
im AS (SELECT lpad(CAST(10000000 + CAST(substr(camera_id, 8) AS BIGINT) AS STRING), 8, '0') AS site_no, make_timestamp(CAST(round_even(epoch_us(t) / 3.6e9, 0) AS BIGINT) * 3600000000) + INTERVAL '290' DAY AS hour_updated,
  count(*) AS images FROM ({IMAGES}) GROUP BY 1, 2)"""


@query("hydro_frame", f"""WITH {HYDRO}
SELECT site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, q.ord, cfs, round(p01m, 6) AS p01m, station,
  CASE WHEN ap IS NULL OR pos - bp <= ap - pos THEN bv ELSE av END AS filled_snow, scene, images FROM q LEFT JOIN sc USING (site_no, hour_updated) LEFT JOIN im USING (site_no, hour_updated)""",
       ("asos_fall", "iv_raw", "flow_utc", "flow_hourly", "weather_hourly", "camera_keys"))
def hydro_frame(d: Inputs) -> DataFrame:
    ranks = F.explode(F.sequence(F.lit(0), F.lit(4)))
    sites = d.view("iv_raw").select("site_no").distinct().withColumn("rank", ranks)
    number = (F.col("site_no").cast("bigint") * 7 + F.col("rank") * 13) % 40
    wanted = sites.select("site_no", "rank", F.concat(F.lit("K"), F.lpad(number.cast("string"), 3, "0")).alias("station"))
    hours = rollups.images_per_hour(camera_images(d), ["camera_id"], "datetime", "key")
    images = hours.select(F.lpad((F.expr("substring(camera_id, 8)").cast("bigint") + 10000000).cast("string"), 8, "0").alias("site_no"), "image_path",
                          (F.col("hour_updated") + F.expr("INTERVAL '290' DAY")).alias("hour_updated"))
    flow = stored(flow_hourly(d), "flow_hours")  # derived once; snow, scenes and the frame read it
    out = catchments.hydro_frame(d.view("iv_raw"), d.view("asos_fall"), wanted, daily_snow(flow), sensed_scenes(flow), images, block=F.to_date("hour_updated"), hours=flow)
    return out.select("site_no", stamp("hour_updated").alias("hour_updated"), "ord", "cfs", *rounded("p01m"), "station", "filled_snow", "scene",
                      F.when(F.col("image_path").isNotNull(), F.size("image_path")).cast("bigint").alias("images"))


@query("basin_swe_series", f"""
WITH m AS ({BASIN_CELLS})
SELECT site_no, strftime(DATE '2024-01-01' + CAST(n AS INT), '%Y-%m-%d') AS datetime, round(avg({_SWE} + n), 6) AS snodas_swe_mm FROM m JOIN cells USING (cell_id), range(10) t(n) GROUP BY 1, 2""", ["cells"])
def basin_swe_series(d: Inputs) -> DataFrame:
    mask = spatial.polygon_join(snow_cells(d), basins(d))
    out = snow.basin_swe_series(dated_cells(d), mask)
    return out.select("site_no", F.col("datetime").cast("string").alias("datetime"), *rounded("snodas_swe_mm"))


@query("basin_swe_bands", f"""
WITH {DEM_SQL}, m AS ({BASIN_CELLS}), k AS (SELECT site_no, CAST(swe_raw AS DOUBLE) AS swe, CAST(z >= 350 AS INT) + CAST(z >= 750 AS INT) AS band
  FROM m JOIN cells USING (cell_id) JOIN (SELECT cell_id, dr * 37 + dc * 11 AS z FROM hit) h USING (cell_id) WHERE swe_raw <> -9999)
SELECT f.site_no, f.band, count(k.swe) AS cells, round(avg(k.swe), 6) AS mean_swe_mm FROM (SELECT site_no, CAST(b AS INT) AS band FROM ({BASINS}), range(3) r(b)) f
LEFT JOIN k USING (site_no, band) GROUP BY 1, 2""", ["cells"])
def basin_swe_bands(d: Inputs) -> DataFrame:
    outlines = basins(d)
    bands = outlines.select("site_no", F.array(F.lit(200.0), F.lit(500.0), F.lit(1000.0)).alias("bands"))
    out = snow.basin_swe_bands(snow_cells(d).drop("elevation_m"), outlines, terrain(d), bands, 0.05)
    return out.select("site_no", "band", "cells", *rounded("mean_swe_mm"))


SNOTEL = """SELECT b.site_no, s.station_id, CAST(s.ord % 3500 AS DOUBLE) * 0.3048 AS z, CAST(s.ord % 400 AS DOUBLE) * 25.4 AS swe FROM stations s
JOIN (SELECT site_no, lon - 0.4 AS w, lat - 0.3 AS s, lon + 0.4 AS e, lat + 0.3 AS n FROM gauges) b ON s.lon BETWEEN b.w AND b.e AND s.lat BETWEEN b.s AND b.n WHERE s.ord % 6 <> 0"""


def snotel_samples(d: Inputs, digits: int | None = None) -> DataFrame:
    from freshet.catalog.linking import gauge_boxes

    s = d.view("stations").withColumn("elevation", (F.col("ord") % 3500).cast("double"))
    readings = s.select("station_id", F.explode(F.sequence(F.lit("2024-06-04").cast("date"), F.lit("2024-06-06").cast("date"))).alias("date"),
                        F.when(F.col("ord") % 6 != 0, (F.col("ord") % 400).cast("double")).alias("WTEQ"))
    return snow.sample_basin_snotel(gauge_boxes(d), s, readings, "2024-06-05", digits=digits)


@query("sample_basin_snotel", f"SELECT site_no, station_id, round(z, 6) AS elevation_m, round(swe, 6) AS swe_mm FROM ({SNOTEL})", ["gauges", "stations"])
def sample_basin_snotel(d: Inputs) -> DataFrame:
    return snotel_samples(d, digits=6)


@query("snow_state", f"""
WITH p AS ({SNOTEL}), l AS (SELECT site_no, max(z) FILTER (WHERE swe <= 1) AS dry, min(z) FILTER (WHERE swe > 1) AS snowy FROM p GROUP BY 1),
n AS (SELECT site_no, CASE WHEN snowy IS NULL THEN 0 WHEN dry IS NULL THEN snowy - 200 WHEN snowy > dry THEN (dry + least(snowy, dry + 400)) / 2 ELSE dry END AS line FROM l),
fit AS (SELECT p.site_no, n.line, greatest(coalesce(sum(greatest(z - line, 1) * swe) FILTER (WHERE swe > 1) / sum(greatest(z - line, 1) * greatest(z - line, 1)) FILTER (WHERE swe > 1), 0), 0) AS slope
  FROM p JOIN n USING (site_no) GROUP BY 1, 2)
SELECT g.site_no, round(list_sum(list_transform(CAST([-1.2815515655446004, -0.5244005127080409, 0.0, 0.5244005127080407, 1.2815515655446004] AS DOUBLE[]),
  lambda q: greatest(0, coalesce(slope, 0) * (1200 + 300 * q - coalesce(line, 0))))) / 5, 6) AS basin_mean_swe_mm FROM gauges g LEFT JOIN fit USING (site_no)""", ["gauges", "stations"])
def snow_state(d: Inputs) -> DataFrame:
    heights = d.view("gauges").select("site_no", F.lit(1200.0).alias("elev_mean_m"), F.lit(300.0).alias("elev_std_m"))
    return snow.snow_state(heights, snotel_samples(d)).select("site_no", *rounded("basin_mean_swe_mm"))


@query("enrich_gauge_meta", """
WITH m AS (SELECT lpad(CAST(10000000 + s_suppkey AS STRING), 8, '0') AS site_no, 'K' || CAST(s_suppkey % 7 AS STRING) AS station_id FROM supplier),
s AS (SELECT site_no, arg_min(tz_cd, ord) AS code, max(cfs) AS hi, min(cfs) AS lo FROM flow_utc GROUP BY 1),
q AS (SELECT site_no, count(*) AS rows, count(*) - count(p01m) AS nan_precip, count(*) - count(cfs) AS nan_flow FROM joined GROUP BY 1)
SELECT m.site_no, code AS time_zone_code, hi AS max_flow, lo AS min_flow, rows, nan_precip, nan_flow, CASE WHEN code IS NOT NULL THEN m.site_no || station_id || '_flow.csv' END AS file,
  CASE WHEN code IS NULL THEN 'no readings' END AS error FROM m LEFT JOIN s USING (site_no) LEFT JOIN q USING (site_no)""", JOINED)
def enrich_gauge_meta(d: Inputs) -> DataFrame:
    meta = d.table("supplier").select(F.lpad((F.col("s_suppkey") + 10000000).cast("string"), 8, "0").alias("site_no"),
                                      F.concat(F.lit("K"), (F.col("s_suppkey") % 7).cast("string")).alias("station_id"))
    out = catchments.enrich_gauge_meta(meta, d.view("iv_raw"), weather_site(d))
    return out.select("site_no", "time_zone_code", "max_flow", "min_flow", "rows", "nan_precip", "nan_flow", "file", "error")


@query("collect_gauge_record", f"""
WITH {CLEAREST}, h AS (SELECT site, count(*) AS days FROM daily_flow WHERE date BETWEEN DATE '1990-01-01' AND DATE '2004-12-31' GROUP BY site),
rec AS (SELECT s_suppkey AS site, coalesce(days, 0) AS days, CASE WHEN s_suppkey % 10 = 9 THEN 'no_gages2' WHEN coalesce(days, 0) < 1460 THEN 'short_history'
  WHEN b.site IS NULL THEN 'no_sentinel_scenes' WHEN product_id IS NULL THEN 'no_valid_patch' ELSE 'ok' END AS status, product_id FROM supplier LEFT JOIN h ON h.site = s_suppkey LEFT JOIN best b ON b.site = s_suppkey)
SELECT site, days AS history_days, status, CASE WHEN status = 'ok' THEN product_id END AS product_id, CASE WHEN status = 'ok' THEN 5479 END AS history_length FROM rec""", ["daily_flow", "scenes"])
def collect_gauge_record(d: Inputs) -> DataFrame:
    gauges = d.table("supplier").select(F.col("s_suppkey").alias("site"))
    attributes = d.table("supplier").filter(F.col("s_suppkey") % 10 != 9).select(F.col("s_suppkey").alias("site"), "s_acctbal", "s_nationkey")
    out = catchments.collect_gauge_record(gauges, attributes, d.view("daily_flow"), d.view("scenes"), "1990-01-01", "2004-12-31", 1460, "site")
    return out.select("site", "history_days", "status", "product_id", F.when(F.col("history").isNotNull(), F.size("history")).alias("history_length"))
