"""Queries of joins between gauges, stations, series and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.catalog.aggregates import (
    BASIN_CELLS, IMAGES, basins, camera_images, listings,
)
from freshet.catalog.frames import flow_hourly, joined, named_site, weather_hourly, weather_site
from freshet.catalog.registry import Inputs, query, rounded, stamp
from freshet.catalog.views import JOINED
from freshet.operators import joins, nearby, rollups, scenes, series, spatial
from freshet.session import stored

KM = ("round(12742 * asin(sqrt(pow(sin(radians(t.lat - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(t.lat))"
      " * pow(sin(radians(t.lon - g.lon) / 2), 2))), 6)")
AXIS = """WITH h AS (SELECT site_no, date_trunc('hour', utc) AS hour, count(*) AS n FROM flow_utc GROUP BY 1, 2),
axis AS (SELECT site_no, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY site_no)"""


@query("densify_hours", AXIS + """
SELECT site_no, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, n FROM axis LEFT JOIN h USING (site_no, hour)""", ["iv_raw", "flow_utc"])
def densify_hours(d: Inputs) -> DataFrame:
    from freshet.operators import clean

    utc = clean.local_to_utc(d.view("iv_raw"))
    hours = utc.groupBy("site_no", F.date_trunc("hour", "datetime").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return joins.densify_hours(hours, ["site_no"]).select("site_no", stamp("hour").alias("hour"), "n")


@query("weather_flow_inner", """
SELECT site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, ord, round(p01m, 6) AS p01m, round(tmpf, 6) AS tmpf,
       skyc1, cfs, count(*) OVER (PARTITION BY site_no) AS rows FROM joined""", JOINED)
def weather_flow_inner(d: Inputs) -> DataFrame:
    both = joined(d)
    counts = rollups.join_quality(both, ["site_no"]).select("site_no", "rows")
    return both.join(counts, "site_no").select("site_no", stamp("hour_updated").alias("hour_updated"), "ord",
                                               *rounded("p01m", "tmpf"), "skyc1", "cfs", "rows")


@query("weather_flow_outer_trim", """
WITH w AS (SELECT lpad(CAST(10000000 + CAST(substr(station, 2) AS BIGINT) AS STRING), 8, '0') AS site_no, hour_updated, p01m FROM weather_hourly),
o AS (SELECT site_no, hour_updated, w.p01m, f.ord, f.cfs FROM w FULL JOIN flow_hourly f USING (site_no, hour_updated)),
r AS (SELECT *, row_number() OVER (PARTITION BY site_no ORDER BY hour_updated, coalesce(ord, -1)) AS a,
  row_number() OVER (PARTITION BY site_no ORDER BY hour_updated DESC, coalesce(ord, -1) DESC) AS b FROM o)
SELECT site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, ord, round(p01m, 6) AS p01m, cfs FROM r WHERE a > 5 AND b > 5""",
       JOINED[:-1])
def weather_flow_outer_trim(d: Inputs) -> DataFrame:
    out = joins.weather_flow_outer_trim(named_site(weather_hourly(d)), flow_hourly(d), ["site_no"], "ord")
    return out.select("site_no", stamp("hour_updated").alias("hour_updated"), "ord", *rounded("p01m"), "cfs")


SOIL = """SELECT site_no, hour_updated, min(ord) AS sms, CAST(CAST(site_no AS BIGINT) % 4 * 30 AS DOUBLE) AS distance_km FROM flow_hourly GROUP BY 1, 2"""
FORCING = """SELECT site_no, hour_updated, CAST(max(ord) % 200 - 50 AS DOUBLE) / 10 AS potential_evaporation FROM flow_hourly GROUP BY 1, 2"""


def soil_forcing(flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = flow.groupBy("site_no", "hour_updated").agg(F.min("ord").alias("sms"), F.max("ord").alias("x"))
    soil = both.select("site_no", "hour_updated", "sms", (F.col("site_no").cast("bigint") % 4 * 30).cast("double").alias("distance_km"))
    forcing = both.select("site_no", "hour_updated", ((F.col("x") % 200 - 50).cast("double") / 10).alias("potential_evaporation"))
    return soil, forcing


@query("hourly_bundle", f"""
WITH soil AS ({SOIL}), forcing AS ({FORCING})
SELECT site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, f.ord, f.cfs, round(w.p01m, 6) AS p01m, s.sms,
  round(greatest(g.potential_evaporation, 0), 6) AS pet_mm_hr
FROM flow_hourly f LEFT JOIN weather_site w USING (site_no, hour_updated) LEFT JOIN (SELECT * FROM soil WHERE distance_km <= 75) s USING (site_no, hour_updated)
LEFT JOIN forcing g USING (site_no, hour_updated)""", JOINED[:-1])
def hourly_bundle(d: Inputs) -> DataFrame:
    flow = flow_hourly(d)
    soil, forcing = soil_forcing(flow)
    out = joins.hourly_bundle(flow, weather_site(d), soil, forcing)
    return out.select("site_no", stamp("hour_updated").alias("hour_updated"), "ord", "cfs", *rounded("p01m"), "sms", *rounded("pet_mm_hr"))


SNOW = """SELECT site_no, CAST(hour_updated AS DATE) AS day, CASE WHEN min(ord) % 4 = 0 THEN NULL ELSE CAST(min(ord) % 90 AS DOUBLE) END AS snow_depth FROM flow_hourly GROUP BY 1, 2"""


def daily_snow(flow: DataFrame) -> DataFrame:
    days = flow.groupBy("site_no", F.to_date("hour_updated").alias("Date")).agg(F.min("ord").alias("m"))
    return days.select("site_no", "Date", F.when(F.col("m") % 4 != 0, (F.col("m") % 90).cast("double")).alias("snow_depth"))


@query("snow_left", f"""
WITH snow AS ({SNOW})
SELECT j.site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, j.ord, snow_depth FROM joined j
LEFT JOIN snow s ON s.site_no = j.site_no AND CAST(s.day AS TIMESTAMP) = j.hour_updated""", JOINED)
def snow_left(d: Inputs) -> DataFrame:
    out = joins.snow_left(joined(d), daily_snow(flow_hourly(d)))
    return out.select("site_no", stamp("hour_updated").alias("hour_updated"), "ord", "snow_depth")


SCENE_TIMES = """SELECT site_no, ord AS scene, hour_updated + to_minutes(CAST(ord % 60 AS INT)) AS sensed FROM flow_hourly WHERE ord % 3 = 0"""


def sensed_scenes(flow: DataFrame) -> DataFrame:
    later = F.timestamp_micros(F.unix_micros("hour_updated") + F.col("ord") % 60 * 60000000)
    return flow.filter(F.col("ord") % 3 == 0).select("site_no", F.col("ord").alias("scene"), later.alias("sensing_time"))


@query("scene_left", f"""
WITH s AS (SELECT site_no, scene, make_timestamp(CAST(round_even(epoch_us(sensed) / 3.6e9, 0) AS BIGINT) * 3600000000) AS hour_updated FROM ({SCENE_TIMES}))
SELECT site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, j.ord, scene FROM joined j LEFT JOIN s USING (site_no, hour_updated)""", JOINED)
def scene_left(d: Inputs) -> DataFrame:
    out = joins.scene_left(joined(d), sensed_scenes(flow_hourly(d)), ["site_no"])
    return out.select("site_no", stamp("hour_updated").alias("hour_updated"), "ord", "scene")


@query("images_left", f"""
WITH images AS ({IMAGES}), h AS (SELECT lpad(CAST(10000000 + CAST(substr(camera_id, 8) AS BIGINT) AS STRING), 8, '0') AS site_no,
  make_timestamp(CAST(round_even(epoch_us(t) / 3.6e9, 0) AS BIGINT) * 3600000000) + INTERVAL '290' DAY AS hour_updated, string_agg(key, ',' ORDER BY t, key) AS paths
  FROM images GROUP BY 1, 2)
SELECT site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, j.ord, paths FROM joined j LEFT JOIN h USING (site_no, hour_updated)""",
       (*JOINED, "camera_keys"))
def images_left(d: Inputs) -> DataFrame:
    number = F.expr("substring(camera_id, 8)").cast("bigint") + 10000000
    hours = rollups.images_per_hour(camera_images(d), ["camera_id"], "datetime", "key")
    images = hours.select(F.lpad(number.cast("string"), 8, "0").alias("site_no"), F.array_join("image_path", ",").alias("paths"),
                          (F.col("hour_updated") + F.expr("INTERVAL '290' DAY")).alias("hour_updated"))
    out = joins.images_left(joined(d), stored(images, "image_hours"), ["site_no"])
    return out.select("site_no", stamp("hour_updated").alias("hour_updated"), "ord", "paths")


@query("merge_series_outer", """
WITH e AS (SELECT user_id % 20 AS station, date_trunc('hour', ts) AS hour, CASE event_id % 3 WHEN 0 THEN 'SMS_-2in' WHEN 1 THEN 'SMS_-8in' ELSE 'WTEQ' END AS variable, max(value) AS value FROM events GROUP BY 1, 2, 3)
SELECT station, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, max(value) FILTER (WHERE variable = 'SMS_-2in') AS sms_2, max(value) FILTER (WHERE variable = 'SMS_-8in') AS sms_8,
  max(value) FILTER (WHERE variable = 'WTEQ') AS wteq FROM e GROUP BY 1, 2""")
def merge_series_outer(d: Inputs) -> DataFrame:
    n = F.col("event_id") % 3
    long = d.table("events").select((F.col("user_id") % 20).alias("station"), F.date_trunc("hour", "ts").alias("hour"), "value",
                                    F.when(n == 0, "SMS_-2in").when(n == 1, "SMS_-8in").otherwise("WTEQ").alias("variable"))
    wide = joins.merge_series_outer(long, ["station", "hour"], ["SMS_-2in", "SMS_-8in", "WTEQ"])
    return wide.select("station", stamp("hour").alias("hour"), F.col("SMS_-2in").alias("sms_2"), F.col("SMS_-8in").alias("sms_8"),
                       F.col("WTEQ").alias("wteq"))


def attribute_tables(d: Inputs) -> list[DataFrame]:
    """Part attributes as basin attribute tables; the later ones cover fewer gauges."""
    p = d.table("part").withColumn("STAID", F.lpad((F.col("p_partkey") + 10000000).cast("string"), 8, "0"))
    basin = p.select("STAID", F.col("p_brand").alias("AGGECO"), F.col("p_retailprice").alias("DRAIN_SQKM"))
    topo = p.filter(F.col("p_partkey") % 3 != 0).select("STAID", F.col("p_size").alias("SLOPE_PCT"), (F.col("p_retailprice") * 2).alias("DRAIN_SQKM"))
    soils = p.filter(F.col("p_partkey") % 4 != 1).select("STAID", (F.col("p_size") + 100).alias("AWCAVE"))
    return [basin, topo, soils]


ATTRIBUTES = """a AS (SELECT lpad(CAST(p_partkey + 10000000 AS STRING), 8, '0') AS staid, p_partkey AS k, p_brand AS aggeco, p_retailprice AS drain, p_size AS slope, p_size + 100 AS awc FROM part)"""


@query("static_attributes", f"""
WITH {ATTRIBUTES} SELECT staid AS "STAID", aggeco AS "AGGECO", round(drain * 2, 6) AS "DRAIN_SQKM", slope AS "SLOPE_PCT", awc AS "AWCAVE" FROM a WHERE k % 3 <> 0 AND k % 4 <> 1""")
def static_attributes(d: Inputs) -> DataFrame:
    basin, topo, soils = attribute_tables(d)
    wanted = basin.join(topo, "STAID", "left_semi").join(soils, "STAID", "left_semi")
    out = joins.static_attributes(wanted, [basin, topo, soils])
    return out.select("STAID", "AGGECO", *rounded("DRAIN_SQKM"), "SLOPE_PCT", "AWCAVE")


@query("static_matrix", f"""
WITH {ATTRIBUTES} SELECT staid AS "STAID", round(drain, 6) AS "DRAIN_SQKM", CASE WHEN k % 3 <> 0 THEN slope END AS "SLOPE_PCT",
  CASE WHEN k % 3 <> 0 THEN round(drain * 2, 6) END AS "DRAIN_SQKM_dup", CASE WHEN k % 4 <> 1 THEN awc END AS "AWCAVE" FROM a""")
def static_matrix(d: Inputs) -> DataFrame:
    out = joins.static_matrix(attribute_tables(d))
    return out.select("STAID", *rounded("DRAIN_SQKM"), "SLOPE_PCT", *rounded("DRAIN_SQKM_dup"), "AWCAVE")


@query("semi_anti_coverage", """
WITH g AS (SELECT lpad(CAST(c_custkey + 10000000 AS STRING), 8, '0') AS id, c_custkey AS k FROM customer),
a AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0)
SELECT id, k IN (SELECT k FROM a) AS flag, CASE WHEN k IN (SELECT k FROM a) THEN 'semi' ELSE 'anti' END AS part FROM g""")
def semi_anti_coverage(d: Inputs) -> DataFrame:
    gauges = d.table("customer").select(F.lpad((F.col("c_custkey") + 10000000).cast("string"), 8, "0").alias("STAID"))
    topo = attribute_tables(d)[1]
    parts = joins.covered(gauges, topo, "STAID", "semi").withColumn("part", F.lit("semi")).unionByName(
        joins.covered(gauges, topo, "STAID", "anti").withColumn("part", F.lit("anti")))
    return joins.covered(gauges, topo, "STAID", "flag", "flag").join(parts, "STAID").select(F.col("STAID").alias("id"), "flag", "part")


BOXES = """SELECT site_no, lon - 0.4 AS min_lon, lat - 0.3 AS min_lat, lon + 0.4 AS max_lon, lat + 0.3 AS max_lat FROM gauges"""


def gauge_boxes(d: Inputs) -> DataFrame:
    return d.view("gauges").select("site_no", (F.col("lon") - 0.4).alias("min_lon"), (F.col("lat") - 0.3).alias("min_lat"),
                                   (F.col("lon") + 0.4).alias("max_lon"), (F.col("lat") + 0.3).alias("max_lat"))


@query("bbox_join", f"""
SELECT b.site_no, s.station_id FROM stations s JOIN ({BOXES}) b ON s.lon BETWEEN b.min_lon AND b.max_lon AND s.lat BETWEEN b.min_lat AND b.max_lat""",
       ["gauges", "stations"])
def bbox_join(d: Inputs) -> DataFrame:
    return spatial.bbox_join(d.view("stations"), gauge_boxes(d)).select("site_no", "station_id")


@query("polygon_join", BASIN_CELLS, ["cells"])
def polygon_join(d: Inputs) -> DataFrame:
    return spatial.polygon_join(d.view("cells"), basins(d))


DEM = """SELECT DISTINCT row, 41.013 - CAST(row AS DOUBLE) / 50 AS lat FROM (SELECT row FROM cells UNION ALL SELECT row + 40 FROM cells)"""


def terrain(d: Inputs) -> DataFrame:
    """Terrain pixels on another raster than the snow cells."""
    shift = F.explode(F.array(F.lit(0), F.lit(40)))
    grid = d.view("cells").withColumn("s", shift).select((F.col("row") + F.col("s")).alias("row"), "col").distinct()
    return grid.select("row", "col", (F.lit(41.013) - F.col("row").cast("double") / 50).alias("lat"),
                       (F.lit(-106.007) + F.col("col").cast("double") / 30).alias("lon"),
                       (F.col("row") * 37 + F.col("col") * 11).cast("double").alias("elevation_m"))


DEM_SQL = f"""r AS ({DEM}), c AS (SELECT DISTINCT col, -106.007 + CAST(col AS DOUBLE) / 30 AS lon FROM cells),
hit AS (SELECT k.cell_id, (SELECT arg_min(r.row, (abs(r.lat - k.lat), r.row)) FROM r) AS dr, (SELECT arg_min(c.col, (abs(c.lon - k.lon), c.col)) FROM c) AS dc FROM cells k)"""


@query("dem_sample_nn", f"WITH {DEM_SQL} SELECT cell_id, CAST(dr * 37 + dc * 11 AS DOUBLE) AS elevation_m FROM hit", ["cells"])
def dem_sample_nn(d: Inputs) -> DataFrame:
    grid = d.view("cells").select("cell_id", "lat", "lon")
    return spatial.dem_sample_nn(grid, terrain(d), 0.05).select("cell_id", "elevation_m")


@query("nearest_station", f"""
SELECT site_no, station_id, km AS distance_km FROM (SELECT g.site_no, t.station_id, {KM} AS km,
  row_number() OVER (PARTITION BY g.site_no ORDER BY {KM}, t.ord) AS k FROM gauges g JOIN stations t ON g.state_cd = t.state_cd) WHERE k = 1""",
       ["gauges", "stations"])
def nearest_station(d: Inputs) -> DataFrame:
    return nearby.nearest_station(d.view("gauges"), d.view("stations"), on=["state_cd"])


@query("nearest_station_any", f"""
SELECT site_no, station_id, km AS distance_km FROM (SELECT g.site_no, t.station_id, {KM} AS km,
  row_number() OVER (PARTITION BY g.site_no ORDER BY {KM}, t.ord) AS k FROM gauges g, stations t) WHERE k = 1""", ["gauges", "stations"])
def nearest_station_any(d: Inputs) -> DataFrame:
    return nearby.nearest_station(d.view("gauges"), d.view("stations"))


@query("best_station", f"""
SELECT g.site_no, b.station_id, b.km AS distance_km, b.begin_date AS element_begin FROM gauges g LEFT JOIN (
  SELECT g.site_no, t.station_id, t.begin_date, {KM} AS km, row_number() OVER (PARTITION BY g.site_no ORDER BY t.begin_date, {KM}, t.ord) AS k
  FROM gauges g, stations t WHERE {KM} <= 75) b ON b.site_no = g.site_no AND b.k = 1""", ["gauges", "stations"])
def best_station(d: Inputs) -> DataFrame:
    return nearby.best_station(d.view("gauges"), d.view("stations"))


@query("k_nearest_stations", f"""
SELECT site_no, station_id, km AS distance_km, k AS rank FROM (SELECT g.site_no, t.station_id, {KM} AS km,
  row_number() OVER (PARTITION BY g.site_no ORDER BY {KM}, t.ord) AS k FROM gauges g, stations t) WHERE k <= 20""", ["gauges", "stations"])
def k_nearest_stations(d: Inputs) -> DataFrame:
    ranked = nearby.k_nearest_stations(d.view("gauges"), d.view("stations"), 20)
    lists = nearby.station_map(ranked)
    return lists.select("site_no", F.inline("stations")).select("site_no", "station_id", "distance_km", "rank")


@query("incremental_delta", """
SELECT 'f/' || CAST(o_orderkey AS STRING) AS path, o_orderkey % 1000 AS size, CASE WHEN o_orderkey % 3 = 1 THEN 'skip' ELSE 'upload' END AS action FROM orders""")
def incremental_delta(d: Inputs) -> DataFrame:
    return joins.incremental_delta(*listings(d)).select("path", "size", "action")


@query("pending_work", """
WITH g AS (SELECT CAST(o_orderkey AS STRING) AS site_no FROM orders)
SELECT site_no, 'retry' AS run FROM g JOIN registry USING (site_no) WHERE status <> 'completed'
UNION ALL SELECT site_no, 'no_retry' FROM g JOIN registry USING (site_no) WHERE status = 'pending'
UNION ALL (SELECT site_no, 'limited' FROM g JOIN registry USING (site_no) WHERE status <> 'completed' ORDER BY site_no LIMIT 20)""", ["registry"])
def pending_work(d: Inputs) -> DataFrame:
    gauges, registry = d.view("registry").select("site_no"), d.view("registry")
    parts = [joins.pending_work(gauges, registry).withColumn("run", F.lit("retry")),
             joins.pending_work(gauges, registry, retry_failed=False).withColumn("run", F.lit("no_retry")),
             joins.pending_work(gauges, registry, limit=20).withColumn("run", F.lit("limited"))]
    return joins.union_tables(parts)


PREFERENCES = """SELECT lpad(CAST(10000000 + s_suppkey AS STRING), 8, '0') AS site_no, r AS rank,
  'K' || lpad(CAST((s_suppkey * 7 + r * 13) % 40 AS STRING), 3, '0') AS station FROM supplier, range(5) t(r)"""


def preferences(d: Inputs) -> DataFrame:
    ranks = F.explode(F.sequence(F.lit(0), F.lit(4)))
    rows = d.table("supplier").withColumn("rank", ranks)
    number = (F.col("s_suppkey") * 7 + F.col("rank") * 13) % 40
    return rows.select(F.lpad((F.col("s_suppkey") + 10000000).cast("string"), 8, "0").alias("site_no"), "rank",
                       F.concat(F.lit("K"), F.lpad(number.cast("string"), 3, "0")).alias("station"))


@query("station_fallback", f"""
SELECT site_no, arg_min(station, rank) AS station FROM ({PREFERENCES}) p WHERE station IN (SELECT station FROM asos_raw) GROUP BY site_no""", ["asos_raw"])
def station_fallback(d: Inputs) -> DataFrame:
    return joins.station_fallback(preferences(d), d.view("asos_raw"))


@query("station_category", f"""
SELECT site_no, rank, station AS station_id, CASE WHEN station IN (SELECT station FROM asos_raw) THEN 'ASOS' ELSE 'ECO' END AS cat
FROM ({PREFERENCES}) p WHERE station IN (SELECT station FROM asos_raw) OR CAST(substr(station, 2) AS BIGINT) % 2 = 0""", ["asos_raw"])
def station_category(d: Inputs) -> DataFrame:
    ranked = preferences(d).withColumnRenamed("station", "station_id")
    eco = ranked.filter(F.substring("station_id", 2, 3).cast("bigint") % 2 == 0).select("station_id")
    data = d.view("asos_raw").select(F.col("station").alias("station_id"))
    return joins.station_category(ranked, data, eco).select("site_no", "rank", "station_id", "cat")


@query("camera_match", """
WITH c AS (SELECT DISTINCT split_part(key, '/', 2) AS camera_id FROM camera_keys)
SELECT s_suppkey, 'overlay/' || camera_id || '/' AS camera_prefix FROM (SELECT s_suppkey, 'CO_Cam_' || CAST(s_suppkey % 12 AS STRING) AS want FROM supplier) g
LEFT JOIN c ON lower(c.camera_id) = lower(g.want)""", ["camera_keys"])
def camera_match(d: Inputs) -> DataFrame:
    named = d.table("supplier").select("s_suppkey", F.lit("CO").alias("state"), F.concat(
        F.lit("CAM  "), (F.col("s_suppkey") % 12).cast("string"), F.lit(" , CO.")).alias("station_nm"))
    cameras = scenes.list_cameras(d.view("camera_keys"), state="CO")
    return joins.camera_match(named, cameras).select("s_suppkey", "camera_prefix")


@query("camera_pattern_match", """
WITH g AS (SELECT lpad(CAST(s_suppkey AS STRING), 8, '0') AS site_no, 'Cam ' || CAST(s_suppkey % 12 AS STRING) AS nm FROM supplier),
p AS (SELECT site_no, unnest(['co_' || replace(lower(nm), ' ', '_'), 'co-' || replace(lower(nm), ' ', '-'), 'co' || replace(lower(nm), ' ', ''), 'co_' || site_no, site_no]) AS pat FROM g),
k AS (SELECT DISTINCT 'overlay/' || split_part(key, '/', 2) || '/' AS prefix, lower(key) AS path FROM camera_keys)
SELECT DISTINCT site_no, prefix FROM p JOIN k ON contains(path, pat)""", ["camera_keys"])
def camera_pattern_match(d: Inputs) -> DataFrame:
    gauges = d.table("supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("site_no"), F.lit("CO").alias("state"),
                                        F.concat(F.lit("Cam "), (F.col("s_suppkey") % 12).cast("string")).alias("station_nm"))
    return joins.camera_pattern_match(gauges, d.view("camera_keys"))


@query("fips_state", """
SELECT o_orderkey, code, CASE code WHEN '08' THEN 'CO' WHEN '49' THEN 'UT' WHEN '12' THEN 'FL' WHEN '06' THEN 'CA' WHEN '72' THEN 'PR' END AS state,
  CASE WHEN code IN ('03', '07') THEN 'unknown state code ' || code END AS error
FROM (SELECT o_orderkey, (['08', '49', '12', '06', '72', '03', '07'])[CAST(o_orderkey % 7 AS INT) + 1] AS code FROM orders)""")
def fips_state(d: Inputs) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in ("08", "49", "12", "06", "72", "03", "07")])
    coded = d.table("orders").select("o_orderkey", F.get(codes, (F.col("o_orderkey") % 7).cast("int")).alias("code"))
    return joins.fips_state(coded, "code")


@query("masked_sites", """
SELECT site_no, state FROM registry WHERE status = 'completed' AND CAST(site_no AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)""", ["registry"])
def masked_sites(d: Inputs) -> DataFrame:
    outlined = d.table("orders").filter(F.col("o_orderkey") % 3 == 0).select(F.col("o_orderkey").cast("string").alias("site_no"))
    return joins.masked_sites(d.view("registry"), outlined).select("site_no", "state")


@query("explorer_rows", """
SELECT CAST(vec_id AS STRING) AS site_no, coalesce(s.s_name, CAST(vec_id AS STRING)) AS station_nm, p.p_retailprice AS drain_sqkm, CAST(p.p_size AS DOUBLE) AS slope_pct,
  CAST(NULL AS DOUBLE) AS elev_m, CAST(NULL AS DOUBLE) AS snow_pct FROM embeddings e LEFT JOIN supplier s ON s.s_suppkey = e.vec_id
LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) p ON p.p_partkey = e.vec_id""")
def explorer_rows(d: Inputs) -> DataFrame:
    bank = d.table("embeddings").select(F.col("vec_id").cast("string").alias("site_no"), "embedding")
    names = d.table("supplier").select(F.col("s_suppkey").cast("string").alias("site_no"), F.col("s_name").alias("station_nm"))
    attributes = d.table("part").filter(F.col("p_partkey") % 3 != 0).select(F.col("p_partkey").cast("string").alias("site_no"), F.create_map(
        F.lit("DRAIN_SQKM"), F.col("p_retailprice"), F.lit("SLOPE_PCT"), F.col("p_size").cast("double")).alias("attributes"))
    return joins.explorer_rows(bank, names, attributes).drop("embedding")
