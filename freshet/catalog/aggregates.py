"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.catalog.frames import joined, snow_cells, weather_hourly
from freshet.catalog.registry import Inputs, query, rounded, stamp
from freshet.catalog.views import JOINED
from freshet.functions import numbers
from freshet.operators import clean, joins, rollups, scenes, spatial

# Outlines over the snow grid: a square, the square with a hole, the square with a second part.
_SQUARE = "[[-105.81,40.61],[-105.41,40.61],[-105.41,40.91],[-105.81,40.91],[-105.81,40.61]]"
_HOLE = "[[-105.66,40.71],[-105.56,40.71],[-105.56,40.81],[-105.66,40.81],[-105.66,40.71]]"
_PART = "[[-105.26,40.31],[-105.06,40.31],[-105.06,40.51],[-105.26,40.51],[-105.26,40.31]]"
SHAPES = {
    "square": f'{{"type":"Polygon","coordinates":[{_SQUARE}]}}',
    "hole": f'{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[{_SQUARE},{_HOLE}]}}}}',
    "parts": f'{{"type":"MultiPolygon","coordinates":[[{_SQUARE}],[{_PART}]]}}',
}


def basins(d: Inputs) -> DataFrame:
    """Every nation is a basin: its outline is one of three shapes, moved with the nation's number."""
    shape = F.get(F.array(*[F.lit(s) for s in SHAPES.values()]), (F.col("n_nationkey") % 3).cast("int"))
    moved = d.table("nation").select(
        F.lpad((F.col("n_nationkey") + 10000000).cast("string"), 8, "0").alias("site_no"),
        spatial.geometry_polygons(shape).alias("polygons"), (F.col("n_nationkey") / F.lit(40.0)).alias("by"))
    return moved.select("site_no", F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(
        r, lambda q: F.array(F.get(q, F.lit(0)) + F.col("by"), F.get(q, F.lit(1)) - F.col("by"))))).alias("polygons"))


# The same basins as SQL over boxes, since every part of every shape is a box.
_IN_BOX = "c.lon > {0} + b.moved AND c.lon < {2} + b.moved AND c.lat > {1} - b.moved AND c.lat < {3} - b.moved"
_IN_SQUARE = _IN_BOX.format(-105.81, 40.61, -105.41, 40.91)
_IN_HOLE = _IN_BOX.format(-105.66, 40.71, -105.56, 40.81)
_IN_PART = _IN_BOX.format(-105.26, 40.31, -105.06, 40.51)
BASIN_CELLS = f"""SELECT b.site_no, c.cell_id FROM cells c JOIN
  (SELECT lpad(CAST(n_nationkey + 10000000 AS STRING), 8, '0') AS site_no, n_nationkey % 3 AS kind,
          CAST(n_nationkey AS DOUBLE) / 40 AS moved FROM nation) b
  ON ({_IN_SQUARE} AND NOT (b.kind = 1 AND {_IN_HOLE})) OR (b.kind = 2 AND {_IN_PART})"""
BASINS = "SELECT lpad(CAST(n_nationkey + 10000000 AS STRING), 8, '0') AS site_no FROM nation"
_SWE = "CASE WHEN swe_raw <> -9999 THEN CAST(swe_raw AS DOUBLE) END"


@query("hourly_weather", """
SELECT station, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, valid, p01m, round(tmpf, 6) AS tmpf,
       round(dwpf, 6) AS dwpf, mslp, skyc1 FROM weather_january""", ["asos_raw", "weather_january"])
def hourly_weather(d: Inputs) -> DataFrame:
    w = weather_hourly(d, "asos_raw")
    return w.select("station", stamp("hour_updated").alias("hour_updated"), "valid", "p01m", *rounded("tmpf", "dwpf"), "mslp", "skyc1")


@query("missing_marks", """
SELECT station, count(*) FILTER (WHERE p01m = 'M') AS missing_p01m, count(*) FILTER (WHERE tmpf = 'M') AS missing_tmpf
FROM asos_raw GROUP BY station""", ["asos_raw"])
def missing_marks(d: Inputs) -> DataFrame:
    return rollups.missing_marks(d.view("asos_raw"), ["p01m", "tmpf"], ["station"])


@query("null_profile", """
WITH n AS (SELECT TRY_CAST(tmpf AS DOUBLE) AS a, TRY_CAST(dwpf AS DOUBLE) AS b, TRY_CAST(mslp AS DOUBLE) AS c FROM asos_raw)
SELECT 'tmpf' AS column_name, count(*) - count(a) AS missing FROM n
UNION ALL SELECT 'dwpf', count(*) - count(b) FROM n UNION ALL SELECT 'mslp', count(*) - count(c) FROM n""", ["asos_raw"])
def null_profile(d: Inputs) -> DataFrame:
    columns = ["tmpf", "dwpf", "mslp"]
    return rollups.null_profile(clean.coerce_numeric(d.view("asos_raw"), columns), columns)


@query("flow_stats", """
SELECT site_no, max(cfs) AS max_flow, min(cfs) AS min_flow, count(*) - count(cfs) AS nan_flow FROM flow_utc GROUP BY site_no""",
       ["iv_raw", "flow_utc"])
def flow_stats(d: Inputs) -> DataFrame:
    return rollups.flow_stats(clean.coerce_numeric(d.view("iv_raw"), ["cfs"]))


@query("join_quality", """
SELECT site_no, count(*) AS rows, count(*) - count(p01m) AS nan_precip, count(*) - count(cfs) AS nan_flow FROM joined GROUP BY site_no""",
       JOINED)
def join_quality(d: Inputs) -> DataFrame:
    return rollups.join_quality(joined(d), ["site_no"])


@query("status_counts", "SELECT status, count(*) AS n FROM registry GROUP BY status", ["registry"])
def status_counts(d: Inputs) -> DataFrame:
    return rollups.status_counts(d.view("registry"))


@query("hourly_resample", """
WITH h AS (SELECT site_no, date_trunc('hour', utc) AS hour, avg(cfs) AS cfs FROM flow_utc GROUP BY 1, 2),
axis AS (SELECT site_no, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY site_no)
SELECT site_no, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, round(cfs, 6) AS cfs FROM axis LEFT JOIN h USING (site_no, hour)""",
       ["iv_raw", "flow_utc"])
def hourly_resample(d: Inputs) -> DataFrame:
    utc = clean.coerce_numeric(clean.local_to_utc(d.view("iv_raw")), ["cfs"])
    dense = joins.densify_hours(rollups.hourly_mean(utc, ["site_no"], "datetime", "cfs"), ["site_no"])
    return dense.select("site_no", stamp("hour").alias("hour"), *rounded("cfs"))


IMAGES = """SELECT split_part(key, '/', 2) AS camera_id, key, ord,
  strptime(regexp_extract(key, '___(.*)Z\\.jpg$', 1), '%Y-%m-%dT%H-%M-%S') AS t FROM camera_keys"""


def camera_images(d: Inputs) -> DataFrame:
    listed = scenes.camera_listing(d.view("camera_keys"))
    return listed.withColumn("camera_id", F.get(F.split("key", "/"), F.lit(1)))


@query("images_per_hour", f"""
WITH images AS ({IMAGES})
SELECT camera_id, strftime(make_timestamp(CAST(round_even(epoch_us(t) / 3.6e9, 0) AS BIGINT) * 3600000000), '%Y-%m-%d %H:%M:%S') AS hour_updated,
       string_agg(key, ',' ORDER BY t, key) AS paths FROM images GROUP BY 1, 2""", ["camera_keys"])
def images_per_hour(d: Inputs) -> DataFrame:
    hours = rollups.images_per_hour(camera_images(d), ["camera_id"], "datetime", "key")
    return hours.select("camera_id", stamp("hour_updated").alias("hour_updated"), F.array_join("image_path", ",").alias("paths"))


SERIES = """SELECT lpad(CAST(10000000 + o_custkey % 50 AS STRING), 8, '0') AS site_no, o_orderkey AS ord,
  CASE o_orderkey % 2 WHEN 0 THEN 'uv' ELSE 'dv' END AS data_type_cd,
  CASE o_orderkey % 3 WHEN 0 THEN '00060' WHEN 1 THEN '00065' ELSE '' END AS parm_cd,
  substr(CAST(date_trunc('month', o_orderdate) AS STRING), 1, 10) AS begin_date,
  CAST(2000 + o_orderkey % 20 AS STRING) || '-12-31' AS end_date, CAST(o_orderkey % 977 AS STRING) AS count_nu FROM orders"""


def series_rows(d: Inputs) -> DataFrame:
    return d.spark.sql(SERIES.replace("FROM orders", "FROM {orders}"), orders=d.table("orders"))


@query("period_of_record", f"""
WITH s AS ({SERIES}), r AS (SELECT *, row_number() OVER (PARTITION BY site_no, data_type_cd, parm_cd ORDER BY begin_date, ord) AS k
  FROM s WHERE parm_cd <> '')
SELECT site_no, data_type_cd || '_' || parm_cd AS series, begin_date, end_date, count_nu AS count FROM r WHERE k = 1""")
def period_of_record(d: Inputs) -> DataFrame:
    return rollups.period_of_record(series_rows(d))


@query("element_begin", """
WITH e AS (SELECT 'S' || CAST(o_custkey % 40 AS STRING) AS triplet, CASE o_orderkey % 4 WHEN 3 THEN 'STO' ELSE 'SMS' END AS element_code,
  CASE WHEN o_custkey % 40 < 10 OR o_orderkey % 3 > 0 THEN 'DAILY' ELSE 'HOURLY' END AS duration,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS begin_date FROM orders)
SELECT triplet, CASE WHEN bool_or(duration = 'HOURLY') THEN min(begin_date) FILTER (WHERE duration = 'HOURLY')
  ELSE min(begin_date) END AS element_begin FROM e WHERE element_code = 'SMS' GROUP BY triplet""")
def element_begin(d: Inputs) -> DataFrame:
    o = d.table("orders")
    station, n = F.col("o_custkey") % 40, F.col("o_orderkey")
    sensors = o.select(
        F.concat(F.lit("S"), station.cast("string")).alias("triplet"),
        F.when(n % 4 == 3, "STO").otherwise("SMS").alias("element_code"),
        F.when((station < 10) | (n % 3 > 0), "DAILY").otherwise("HOURLY").alias("duration"),
        F.when(n % 7 != 0, F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" 00:00"))).alias("begin_date"))
    return rollups.element_begin(sensors)


@query("data_availability", """
WITH b AS (SELECT c_custkey AS id, CAST(1990 + c_custkey % 20 AS STRING) || '-05-01' AS u,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(1970 + c_custkey % 31 AS STRING) || '-02-01' END AS a,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(1995 + c_custkey % 13 AS STRING) || '-07-01' END AS s,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '2015-07-04' END AS t FROM customer),
c AS (SELECT *, CASE WHEN a IS NOT NULL AND s IS NOT NULL THEN greatest(u, a, s, '1979-01-02') END AS tab FROM b)
SELECT id, tab AS aligned_tabular_begin, CASE WHEN tab IS NOT NULL AND t IS NOT NULL THEN greatest(tab, t) END AS aligned_multimodal_begin FROM c""")
def data_availability(d: Inputs) -> DataFrame:
    k = F.col("c_custkey")

    def begin(base: int, span: int, tail: str):
        return F.concat((k % span + base).cast("string"), F.lit(tail))

    rows = d.table("customer").select(
        k.alias("id"), begin(1990, 20, "-05-01").alias("usgs_hourly_begin"),
        F.when(k % 4 != 0, begin(1970, 31, "-02-01")).alias("asos_begin"),
        F.when(k % 5 != 0, begin(1995, 13, "-07-01")).alias("scan_begin"), F.lit("1979-01-02").alias("nldas_begin"),
        F.when(k % 3 != 0, F.lit("2015-07-04")).alias("sentinel_begin"))
    return rollups.data_availability(rows, "id").select("id", "aligned_tabular_begin", "aligned_multimodal_begin")


@query("basin_bbox", """
SELECT lpad(CAST(n_nationkey + 10000000 AS STRING), 8, '0') AS site_no, round(-105.81 + moved - 0.05, 6) AS min_lon,
  round(CASE WHEN n_nationkey % 3 = 2 THEN 40.31 ELSE 40.61 END - moved - 0.05, 6) AS min_lat,
  round(CASE WHEN n_nationkey % 3 = 2 THEN -105.06 ELSE -105.41 END + moved + 0.05, 6) AS max_lon,
  round(40.91 - moved + 0.05, 6) AS max_lat FROM (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / 40 AS moved FROM nation)""")
def basin_bbox(d: Inputs) -> DataFrame:
    return spatial.basin_bbox(basins(d)).select("site_no", *rounded("min_lon", "min_lat", "max_lon", "max_lat"))


@query("basin_mean_polygon", f"""
WITH m AS ({BASIN_CELLS})
SELECT site_no, round(avg({_SWE}), 6) AS mean_swe_mm, count({_SWE}) AS cells FROM m JOIN cells USING (cell_id) GROUP BY site_no""",
       ["cells"])
def basin_mean_polygon(d: Inputs) -> DataFrame:
    grid = snow_cells(d)
    mask = spatial.polygon_join(grid, basins(d))
    return spatial.basin_mean(grid, mask).select("site_no", *rounded("mean_swe_mm"), "cells")


@query("basin_mean_bbox", f"""
SELECT site_no, round(avg({_SWE}), 6) AS mean_swe_mm, count({_SWE}) AS cells FROM cells c JOIN
 (SELECT lpad(CAST(n_nationkey + 10000000 AS STRING), 8, '0') AS site_no, n_nationkey % 3 AS kind, CAST(n_nationkey AS DOUBLE) / 40 AS moved FROM nation) b
 ON c.lon BETWEEN -105.81 + moved AND CASE WHEN kind = 2 THEN -105.06 ELSE -105.41 END + moved
 AND c.lat BETWEEN CASE WHEN kind = 2 THEN 40.31 ELSE 40.61 END - moved AND 40.91 - moved GROUP BY site_no""", ["cells"])
def basin_mean_bbox(d: Inputs) -> DataFrame:
    boxes = spatial.basin_bbox(basins(d), buffer_degrees=0.0)
    return spatial.basin_mean_bbox(snow_cells(d), boxes).select("site_no", *rounded("mean_swe_mm"), "cells")


def dated_cells(d: Inputs) -> DataFrame:
    """The grid on ten days, each day's snow a bit deeper."""
    days = F.explode(F.sequence(F.lit(0), F.lit(9)))
    return (snow_cells(d).withColumn("n", days).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")))
            .withColumn("swe_mm", F.col("swe_mm") + F.col("n")))


@query("basin_mean_mask", f"""
WITH m AS ({BASIN_CELLS})
SELECT site_no, strftime(DATE '2024-01-01' + CAST(n AS INT), '%Y-%m-%d') AS date, round(avg({_SWE} + n), 6) AS mean_swe_mm,
  count({_SWE}) AS cells FROM m JOIN cells USING (cell_id), range(10) t(n) GROUP BY 1, 2""", ["cells"])
def basin_mean_mask(d: Inputs) -> DataFrame:
    grid = dated_cells(d)
    mask = spatial.polygon_join(snow_cells(d), basins(d))
    means = spatial.basin_mean_mask(grid, mask)
    return means.select("site_no", F.col("date").cast("string").alias("date"), *rounded("mean_swe_mm"), "cells")


BANDS = [1500.0, 2000.0, 2500.0, 3000.0]


@query("band_means", f"""
WITH m AS ({BASIN_CELLS}), k AS (
  SELECT site_no, CAST(swe_raw AS DOUBLE) AS swe, CAST(elevation_m >= 1750 AS INT) + CAST(elevation_m >= 2250 AS INT) + CAST(elevation_m >= 2750 AS INT) AS band
  FROM m JOIN cells USING (cell_id) WHERE swe_raw <> -9999)
SELECT f.site_no, f.band, round(1500.0 + 500 * f.band, 6) AS band_elevation_m, count(k.swe) AS cells, round(avg(k.swe), 6) AS mean_swe_mm,
  round(any_value(t.mean), 6) AS basin_mean_swe_mm
FROM (SELECT site_no, CAST(b AS INT) AS band FROM ({BASINS}), range(4) r(b)) f LEFT JOIN k USING (site_no, band)
LEFT JOIN (SELECT site_no, avg(swe) AS mean FROM k GROUP BY site_no) t USING (site_no) GROUP BY 1, 2""", ["cells"])
def band_means(d: Inputs) -> DataFrame:
    grid, outlines = snow_cells(d), basins(d)
    bands = outlines.select("site_no", F.array(*[F.lit(b) for b in BANDS]).alias("bands"))
    out = spatial.band_means(grid, spatial.polygon_join(grid, outlines), bands)
    return out.select("site_no", "band", *rounded("band_elevation_m"), "cells", *rounded("mean_swe_mm", "basin_mean_swe_mm"))


SAMPLES = """SELECT state_cd, ord, CAST(ord % 3500 AS DOUBLE) AS z, CASE WHEN state_cd % 5 = 0 AND ord % 2 = 0 THEN 0.0 ELSE CAST(ord % 400 AS DOUBLE) END AS s FROM stations"""
FIT = f"""WITH p AS ({SAMPLES}), l AS (SELECT state_cd, max(z) FILTER (WHERE s <= 1) AS dry, min(z) FILTER (WHERE s > 1) AS snowy FROM p GROUP BY state_cd),
n AS (SELECT state_cd, CASE WHEN snowy IS NULL THEN 0 WHEN dry IS NULL THEN snowy - 200 WHEN snowy > dry THEN (dry + least(snowy, dry + 400)) / 2 ELSE dry END AS line FROM l),
fit AS (SELECT p.state_cd, n.line, greatest(coalesce(sum(greatest(z - line, 1) * s) FILTER (WHERE s > 1)
  / sum(greatest(z - line, 1) * greatest(z - line, 1)) FILTER (WHERE s > 1), 0), 0) AS slope FROM p JOIN n USING (state_cd) GROUP BY 1, 2)"""


def snow_samples(d: Inputs) -> DataFrame:
    dry = (F.col("state_cd") % 5 == 0) & (F.col("ord") % 2 == 0)
    return d.view("stations").select("state_cd", "ord", (F.col("ord") % 3500).cast("double").alias("elevation_m"),
                                     F.when(dry, 0.0).otherwise((F.col("ord") % 400).cast("double")).alias("swe_mm"))


@query("snow_profile_fit", FIT + " SELECT state_cd, round(line, 6) AS snow_line, round(slope, 6) AS slope FROM fit", ["stations"])
def snow_profile_fit(d: Inputs) -> DataFrame:
    return rollups.snow_profile_fit(snow_samples(d), ["state_cd"]).select("state_cd", *rounded("snow_line", "slope"))


@query("band_swe_estimate", FIT + """ SELECT state_cd, round(list_sum(list_transform([500.0, 1500.0, 3500.0], lambda z: greatest(0, slope * (z - line)))) / 3, 6)
 AS basin_mean_swe_mm FROM fit""", ["stations"])
def band_swe_estimate(d: Inputs) -> DataFrame:
    fit = rollups.snow_profile_fit(snow_samples(d), ["state_cd"])
    banded = fit.withColumn("bands", F.array(F.lit(500.0), F.lit(1500.0), F.lit(3500.0)))
    return rollups.band_swe_estimate(banded).select("state_cd", *rounded("basin_mean_swe_mm"))


PET = """WITH t AS (SELECT station, CAST(valid || ':00' AS TIMESTAMP) AS ts, ord, 35 + CAST(substr(station, 2) AS BIGINT) AS lat,
  (TRY_CAST(tmpf AS DOUBLE) - 32) * 5 / 9 AS c FROM asos_raw),
d AS (SELECT station, lat, CAST(ts AS DATE) AS day, dayofyear(ts) AS doy, min(c) AS tmin, max(c) AS tmax, avg(c) AS tmean FROM t GROUP BY 1, 2, 3, 4),
g AS (SELECT *, radians(lat) AS phi, 0.409 * sin(2 * pi() / 365 * doy - 1.39) AS del, 1 + 0.033 * cos(2 * pi() / 365 * doy) AS dr FROM d),
w AS (SELECT *, acos(least(greatest(-tan(phi) * tan(del), -1), 1)) AS ws FROM g),
p AS (SELECT *, CASE WHEN tmean IS NOT NULL THEN greatest(0.0023 * (1440 / pi()) * 0.082 * dr * (ws * sin(phi) * sin(del) + cos(phi) * cos(del) * sin(ws)) * 0.408
  * sqrt(greatest(tmax - tmin, 0)) * (tmean + 17.8), 0) END AS pet FROM w)"""


def station_temps(d: Inputs) -> DataFrame:
    latitude = F.substring("station", 2, 3).cast("double") + 35.0
    return d.view("asos_raw").select("station", "ord", F.to_timestamp("valid", "yyyy-MM-dd HH:mm").alias("ts"),
                                     latitude.alias("lat"), numbers.fahrenheit_to_c(numbers.to_number(F.col("tmpf"))).alias("c"))


@query("daily_temp_pet", PET + """,
h AS (SELECT t.station, t.ord, hour(t.ts) AS hr, p.pet, 24 / pi() * p.ws AS dl FROM t JOIN p ON p.station = t.station AND p.day = CAST(t.ts AS DATE))
SELECT station, ord, round(pet * greatest(sin(pi() * (hr + 0.5 - 12 + dl / 2) / dl), 0)
  / list_sum(list_transform(range(24), lambda k: greatest(sin(pi() * (k + 0.5 - 12 + dl / 2) / dl), 0))), 6) AS pet_mm_hr FROM h""", ["asos_raw"])
def daily_temp_pet(d: Inputs) -> DataFrame:
    temps = station_temps(d)
    out = rollups.hourly_pet(temps, ["station"], "ts", F.col("c"), F.col("lat"))
    return out.select("station", "ord", *rounded("pet_mm_hr"))


@query("valid_fraction", """
SELECT o_custkey % 25 AS scene, round(avg(CASE WHEN greatest(o_orderkey % 3, o_orderkey % 5) > 0 THEN 1.0 ELSE 0.0 END), 6) AS valid_fraction
FROM orders GROUP BY 1""")
def valid_fraction(d: Inputs) -> DataFrame:
    pixels = d.table("orders").select((F.col("o_custkey") % 25).alias("scene"), (F.col("o_orderkey") % 3).alias("b02"),
                                      (F.col("o_orderkey") % 5).alias("b03"))
    return rollups.valid_fraction(pixels, ["scene"], ["b02", "b03"]).select("scene", *rounded("valid_fraction"))


@query("run_summary", """
SELECT state, count(*) FILTER (WHERE status = 'completed') AS chunks_fetched, count(*) FILTER (WHERE status = 'pending') AS chunks_skipped,
  count(*) FILTER (WHERE status = 'failed') AS chunk_failures,
  CAST(coalesce(sum(CASE WHEN status <> 'failed' THEN CAST(site_no AS BIGINT) % 100 END), 0) AS BIGINT) AS combined_rows
FROM registry GROUP BY state""", ["registry"])
def run_summary(d: Inputs) -> DataFrame:
    named = F.create_map(*[F.lit(x) for x in ("completed", "fetched", "pending", "skipped", "failed", "failed")])
    log = d.view("registry").select("state", named[F.col("status")].alias("status"), (F.col("site_no").cast("bigint") % 100).alias("rows"))
    return rollups.run_summary(log, ["state"])


@query("sync_summary", """
WITH l AS (SELECT o_orderkey, o_orderkey % 1000 AS size, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderkey % 1000 ELSE -1 END AS there FROM orders)
SELECT count(*) FILTER (WHERE there IS DISTINCT FROM size) AS uploaded, count(*) FILTER (WHERE there = size) AS skipped,
  CAST(sum(CASE WHEN there IS DISTINCT FROM size THEN size ELSE 0 END) AS BIGINT) AS bytes_uploaded FROM l""")
def sync_summary(d: Inputs) -> DataFrame:
    local, remote = listings(d)
    return rollups.sync_summary(joins.incremental_delta(local, remote))


def listings(d: Inputs) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    o = d.table("orders")
    path = F.concat(F.lit("f/"), k.cast("string")).alias("path")
    local = o.select(path, (k % 1000).alias("size"))
    remote = o.filter(k % 3 != 0).select(path, F.when(k % 3 == 1, k % 1000).otherwise(F.lit(-1)).cast("bigint").alias("size"))
    return local, remote


@query("densify_days", """
WITH axis AS (SELECT site, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily_flow GROUP BY site)
SELECT site, strftime(date, '%Y-%m-%d') AS date, cfs FROM axis LEFT JOIN daily_flow USING (site, date)""", ["daily_flow"])
def densify_days(d: Inputs) -> DataFrame:
    dense = joins.densify_hours(d.view("daily_flow"), ["site"], "date", step="day")
    return dense.select("site", F.col("date").cast("string").alias("date"), "cfs")
