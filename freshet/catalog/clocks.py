"""Queries of scalar functions, through their SQL registration where they have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.catalog.registry import Inputs, query
from freshet.functions import geo, sql, text
from freshet.operators import joins
from freshet.sources import grids


def run_sql(d: Inputs, body: str, **frames: DataFrame) -> DataFrame:
    sql.register(d.spark)
    return d.spark.sql(body, **frames)


@query("haversine_km", """
SELECT g.site_no, t.station_id, round(12742 * asin(sqrt(pow(sin(radians(t.lat - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(t.lat))
  * pow(sin(radians(t.lon - g.lon) / 2), 2))), 6) AS km FROM gauges g JOIN stations t ON g.state_cd = t.state_cd""", ["gauges", "stations"])
def haversine_km(d: Inputs) -> DataFrame:
    """A state holds many gauges and many stations, so its pairs are spread over many tasks."""
    gauges = d.view("gauges").select("site_no", "state_cd", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    pairs = joins.dealt_join(gauges, d.view("stations").select("station_id", "state_cd", "lat", "lon"), ["state_cd"])
    return run_sql(d, "SELECT site_no, station_id, round(haversine_km(g_lat, g_lon, lat, lon), 6) AS km FROM {p}", p=pairs)


@query("hydrologic_year", """SELECT o_orderkey, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS wy FROM orders""")
def hydrologic_year(d: Inputs) -> DataFrame:
    return run_sql(d, "SELECT o_orderkey, hydrologic_year(CAST(o_orderdate AS DATE)) AS wy FROM {o}", o=d.table("orders"))


_SUN = """WITH b AS (SELECT c_custkey, radians(-60 + c_custkey % 120) AS phi, 1 + c_custkey % 365 AS doy FROM customer),
g AS (SELECT *, 0.409 * sin(2 * pi() / 365 * doy - 1.39) AS del, 1 + 0.033 * cos(2 * pi() / 365 * doy) AS dr FROM b),
w AS (SELECT *, acos(least(greatest(-tan(phi) * tan(del), -1), 1)) AS ws FROM g),
ra AS (SELECT *, (1440 / pi()) * 0.082 * dr * (ws * sin(phi) * sin(del) + cos(phi) * cos(del) * sin(ws)) * 0.408 AS ra FROM w)"""
_PLACES = "SELECT c_custkey, CAST(-60 + c_custkey % 120 AS DOUBLE) AS lat, CAST(1 + c_custkey % 365 AS DOUBLE) AS doy, c_acctbal FROM {c}"


@query("extraterrestrial_radiation", _SUN + " SELECT c_custkey, round(ra, 6) AS ra FROM ra")
def extraterrestrial_radiation(d: Inputs) -> DataFrame:
    return run_sql(d, f"SELECT c_custkey, round(extraterrestrial_radiation(lat, doy), 6) AS ra FROM ({_PLACES})", c=d.table("customer"))


@query("hargreaves_pet", _SUN + """ SELECT c_custkey, round(greatest(0.0023 * ra * sqrt(greatest(CAST(c_custkey % 40 - 10 - (c_custkey % 17) AS DOUBLE), 0))
  * (CAST(c_custkey % 40 - 10 + c_custkey % 17 AS DOUBLE) / 2 + 17.8), 0), 6) AS pet FROM ra""")
def hargreaves_pet(d: Inputs) -> DataFrame:
    return run_sql(d, f"""SELECT c_custkey, round(hargreaves_pet(CAST(c_custkey % 17 AS DOUBLE), CAST(c_custkey % 40 - 10 AS DOUBLE),
        CAST(c_custkey % 40 - 10 + c_custkey % 17 AS DOUBLE) / 2, lat, doy), 6) AS pet FROM ({_PLACES})""", c=d.table("customer"))


@query("daylight_weights", _SUN + """, l AS (SELECT c_custkey, 24 / pi() * ws AS dl FROM w),
h AS (SELECT c_custkey, CAST(k AS INT) AS hour, greatest(sin(pi() * (k + 0.5 - 12 + dl / 2) / dl), 0) AS r FROM l, range(24) t(k))
SELECT c_custkey, hour, round(r / sum(r) OVER (PARTITION BY c_custkey), 6) AS weight FROM h""")
def daylight_weights(d: Inputs) -> DataFrame:
    rows = run_sql(d, f"SELECT c_custkey, daylight_weights(lat, doy) AS w FROM ({_PLACES})", c=d.table("customer"))
    return rows.select("c_custkey", F.posexplode("w").alias("hour", "x")).select("c_custkey", "hour", F.round("x", 6).alias("weight"))


@query("uniform_weights", """SELECT c_custkey, CAST(k AS INT) AS hour, round(1.0 / 24, 6) AS weight FROM customer, range(24) t(k)""")
def uniform_weights(d: Inputs) -> DataFrame:
    rows = run_sql(d, "SELECT c_custkey, uniform_weights() AS w FROM {c}", c=d.table("customer"))
    return rows.select("c_custkey", F.posexplode("w").alias("hour", "x")).select("c_custkey", "hour", F.round("x", 6).alias("weight"))


# Standard normal quantiles at 0.1, 0.3, 0.5, 0.7 and 0.9.
_Z = "[-1.2815515655446004, -0.5244005127080409, 0.0, 0.5244005127080407, 1.2815515655446004]"


@query("equal_area_bands", f"""
SELECT p_partkey, CAST(b AS INT) AS band, round(p_retailprice + greatest(CAST(p_size - 5 AS DOUBLE), 1) * ({_Z})[CAST(b AS INT) + 1], 6) AS elevation_m FROM part, range(5) t(b)""")
def equal_area_bands(d: Inputs) -> DataFrame:
    bands = geo.equal_area_bands(F.col("p_retailprice"), (F.col("p_size") - 5).cast("double"), 5)
    return d.table("part").select("p_partkey", F.posexplode(bands).alias("band", "z")).select(
        "p_partkey", "band", F.round("z", 6).alias("elevation_m"))


@query("band_index", """
SELECT cell_id, CAST(elevation_m >= 1750 AS INT) + CAST(elevation_m >= 2250 AS INT) + CAST(elevation_m >= 2750 AS INT) AS band,
  CAST(elevation_m >= 1750 AS INT) + CAST(elevation_m >= 2250 AS INT) + CAST(elevation_m >= 2750 AS INT) AS sql_band FROM cells""", ["cells"])
def band_index(d: Inputs) -> DataFrame:
    rows = run_sql(d, """SELECT cell_id, CAST(elevation_m AS DOUBLE) AS z,
        band_index(CAST(elevation_m AS DOUBLE), array(1500D, 2000D, 2500D, 3000D)) AS sql_band FROM {c}""", c=d.view("cells"))
    bands = F.array(*[F.lit(b) for b in (1500.0, 2000.0, 2500.0, 3000.0)])
    return rows.select("cell_id", geo.band_index(F.col("z"), bands).alias("band"), "sql_band")


@query("terrain_elevation", """
SELECT event_id, CAST(event_id % 256 * 256 + user_id % 256 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) / 256 - 32768 AS z,
  round((100 * 256 + event_id % 256 + 0.5) / 131072 * 360 - 180, 6) AS lon,
  round(degrees(atan(sinh(pi() * (1 - 2 * (190 * 256 + event_id % 256 + 0.5) / 131072)))), 6) AS lat FROM events""")
def terrain_elevation(d: Inputs) -> DataFrame:
    rows = run_sql(d, """SELECT event_id, terrain_elevation(CAST(event_id % 256 AS DOUBLE), CAST(user_id % 256 AS DOUBLE), CAST(event_id % 7 AS DOUBLE)) AS z
        FROM {e}""", e=d.table("events"))
    at = F.col("event_id") % 256
    return rows.select("event_id", "z", F.round(geo.pixel_lon(at + 25600, 9), 6).alias("lon"), F.round(geo.pixel_lat(at + 48640, 9), 6).alias("lat"))


@query("cyclical_time", """
SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
  round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos FROM events""")
def cyclical_time(d: Inputs) -> DataFrame:
    return run_sql(d, """SELECT event_id, round(hour_sin(hour(ts)), 6) AS hour_sin, round(hour_cos(hour(ts)), 6) AS hour_cos,
        round(month_sin(month(ts)), 6) AS month_sin, round(month_cos(month(ts)), 6) AS month_cos FROM {e}""", e=d.table("events"))


@query("log_drainage", "SELECT p_partkey, round(log10(greatest(p_retailprice - 950, 1)), 6) AS x FROM part")
def log_drainage(d: Inputs) -> DataFrame:
    return run_sql(d, "SELECT p_partkey, round(log_drainage(p_retailprice - 950), 6) AS x FROM {p}", p=d.table("part"))


@query("source_paths", """
WITH o AS (SELECT o_orderkey, o_orderdate AS t, strftime(o_orderdate, '%Y%m%d') AS d8, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS wy,
  (['stable', 'provisional', 'early'])[CAST(o_orderkey % 3 AS INT) + 1] AS v FROM orders)
SELECT o_orderkey, 'https://noaadata.apps.nsidc.org/NOAA/G02158/masked/' || strftime(t, '%Y/%m_%b') || '/SNODAS_' || d8 || '.tar' AS tar,
  'https://noaadata.apps.nsidc.org/NOAA/G02158/unmasked/' || strftime(t, '%Y/%m_%b') || '/SNODAS_unmasked_' || d8 || '.tar' AS full_tar,
  'https://climate.arizona.edu/data/UA_SWE/DailyData_4km/WY' || CAST(wy AS STRING) || '/UA_SWE_Depth_4km_v1_' || d8 || '_' || v || '.nc' AS day_file,
  'https://climate.arizona.edu/data/UA_SWE/WYData_4km/UA_SWE_Depth_WY' || CAST(wy AS STRING) || '.nc' AS year_file,
  'https://daacdata.apps.nsidc.org/pub/DATASETS/nsidc0719_SWE_Snow_Depth_v1/4km_SWE_Depth_WY' || CAST(wy AS STRING) || '_v01.nc' AS final_file,
  'maps/daily/' || d8 || '.json' AS day_map FROM o""")
def source_paths(d: Inputs) -> DataFrame:
    from freshet.functions.clock import hydrologic_year as wy

    day = F.to_date("o_orderdate")
    variant = F.get(F.array(F.lit("stable"), F.lit("provisional"), F.lit("early")), (F.col("o_orderkey") % 3).cast("int"))
    return d.table("orders").select(
        "o_orderkey", text.snow_tar_path(day).alias("tar"), text.snow_tar_path(day, masked=False).alias("full_tar"),
        text.snow_day_path(day, variant).alias("day_file"), text.snow_year_path(wy(day)).alias("year_file"),
        text.snow_year_path(wy(day), final_archive=True).alias("final_file"), text.day_map_path("maps", day).alias("day_map"))


@query("variant_preference", """
WITH v AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS rank FROM orders)
SELECT day, (['stable', 'provisional', 'early'])[min(rank)] AS variant FROM v GROUP BY day""")
def variant_preference(d: Inputs) -> DataFrame:
    """Order states stand for the file variants that exist for a day."""
    from freshet.operators.rollups import preferred_variant

    variant = F.when(F.col("o_orderstatus") == "F", "stable").when(F.col("o_orderstatus") == "O", "provisional").otherwise("early")
    files = d.table("orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day"), variant.alias("variant"))
    return preferred_variant(files).select("day", "variant")


@query("tile_plan", """
WITH b AS (SELECT site_no, lon - 0.4 AS w, lat - 0.3 AS s, lon + 0.4 AS e, lat + 0.3 AS n FROM gauges),
t AS (SELECT site_no, CAST(floor((w + 180) / 360 * 512) AS BIGINT) AS x0, CAST(floor((e + 180) / 360 * 512) AS BIGINT) AS x1,
  CAST(floor((1 - asinh(tan(radians(n))) / pi()) / 2 * 512) AS BIGINT) AS y0, CAST(floor((1 - asinh(tan(radians(s))) / pi()) / 2 * 512) AS BIGINT) AS y1 FROM b)
SELECT site_no, x, y FROM (SELECT site_no, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM t), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)""", ["gauges"])
def tile_plan(d: Inputs) -> DataFrame:
    from freshet.catalog.linking import gauge_boxes

    return grids.tile_plan(gauge_boxes(d), 9).select("site_no", "x", "y")


@query("sql_clock_functions", """
SELECT event_id, strftime(date_trunc('hour', ts) + CASE WHEN minute(ts) = 0 THEN INTERVAL '0' HOUR ELSE INTERVAL '1' HOUR END, '%Y-%m-%d %H:%M:%S') AS up,
  strftime(make_timestamp(CAST(round_even(epoch_us(ts) / 3.6e9, 0) AS BIGINT) * 3600000000), '%Y-%m-%d %H:%M:%S') AS near,
  strftime(((ts + INTERVAL '290' DAY) AT TIME ZONE 'America/Denver') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM events""")
def sql_clock_functions(d: Inputs) -> DataFrame:
    return run_sql(d, """SELECT event_id, date_format(ceil_to_hour(ts), 'yyyy-MM-dd HH:mm:ss') AS up, date_format(round_to_hour(ts), 'yyyy-MM-dd HH:mm:ss') AS near,
        date_format(local_to_utc(ts + INTERVAL '290' DAY, clock_zone('MST')), 'yyyy-MM-dd HH:mm:ss') AS utc FROM {e}""", e=d.table("events"))
