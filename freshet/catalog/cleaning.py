"""Queries of cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.catalog.frames import flow_hourly, joined
from freshet.catalog.registry import Inputs, query, rounded, stamp
from freshet.catalog.views import FLOW, JOINED
from freshet.functions import clock, numbers, text
from freshet.operators import clean, scenes


@query("rename_by_param", """
SELECT event_id AS ord, CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS STRING) AS cfs,
       CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS STRING) END AS height, CAST(NULL AS STRING) AS precip_usgs
FROM events""")
def rename_by_param(d: Inputs) -> DataFrame:
    e = d.table("events")
    cfs = F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string"))
    values = F.create_map(F.lit("9_00060_cd"), F.lit("A"), F.lit("200_00060"), F.lit("-1"), F.lit("31_00060"), cfs)
    height = F.create_map(F.lit("7_00065"), F.col("user_id").cast("string"))
    keyed = e.select(F.col("event_id").alias("ord"),
                     F.when(F.col("event_id") % 3 == 0, F.map_concat(values, height)).otherwise(values).alias("values"))
    return clean.rename_by_param(keyed)


@query("coerce_numeric", """
SELECT ord, TRY_CAST(tmpf AS DOUBLE) AS tmpf, TRY_CAST(dwpf AS DOUBLE) AS dwpf, TRY_CAST(p01m AS DOUBLE) AS p01m,
       TRY_CAST(mslp AS DOUBLE) AS mslp FROM asos_raw""", ["asos_raw"])
def coerce_numeric(d: Inputs) -> DataFrame:
    columns = ["tmpf", "dwpf", "p01m", "mslp"]
    return clean.coerce_numeric(d.view("asos_raw"), columns).select("ord", *columns)


@query("null_fills", "SELECT cell_id, CASE WHEN swe_raw <> -9999 THEN CAST(swe_raw AS DOUBLE) END AS swe_mm FROM cells",
       ["cells"])
def null_fills(d: Inputs) -> DataFrame:
    grid = d.view("cells").withColumn("swe_mm", F.col("swe_raw").cast("double"))
    return clean.null_fills(grid, ["swe_mm"], equals=-9999.0, at_most=-9990.0).select("cell_id", "swe_mm")


@query("local_to_utc", "SELECT site_no, ord, strftime(utc, '%Y-%m-%d %H:%M:%S') AS utc FROM flow_utc",
       ["iv_raw", "flow_utc"])
def local_to_utc(d: Inputs) -> DataFrame:
    return clean.local_to_utc(d.view("iv_raw")).select("site_no", "ord", stamp("datetime").alias("utc"))


@query("top_of_hour", """
SELECT site_no, ord, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated FROM flow_hourly""", FLOW)
def top_of_hour(d: Inputs) -> DataFrame:
    utc = clean.local_to_utc(d.view("iv_raw"))
    return clean.top_of_hour(utc).select("site_no", "ord", stamp("datetime").alias("hour_updated"))


@query("ceil_to_hour", """
SELECT ord, strftime(CASE WHEN substr(valid, 15, 2) = '00' THEN CAST(valid || ':00' AS TIMESTAMP)
  ELSE date_trunc('hour', CAST(valid || ':00' AS TIMESTAMP)) + INTERVAL '1' HOUR END, '%Y-%m-%d %H:%M:%S') AS hour_updated
FROM asos_raw""", ["asos_raw"])
def ceil_to_hour(d: Inputs) -> DataFrame:
    ts = F.to_timestamp("valid", "yyyy-MM-dd HH:mm")
    return d.view("asos_raw").select("ord", stamp(clock.ceil_to_hour(ts)).alias("hour_updated"))


@query("round_to_hour", """
SELECT event_id, strftime(make_timestamp(CAST(round_even(epoch_us(t) / 3.6e9, 0) AS BIGINT) * 3600000000), '%Y-%m-%d %H:%M:%S') AS hour
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('hour', ts) + INTERVAL '30' MINUTE ELSE ts END AS t FROM events)""")
def round_to_hour(d: Inputs) -> DataFrame:
    half = F.date_trunc("hour", "ts") + F.expr("INTERVAL '30' MINUTE")
    t = F.when(F.col("event_id") % 2 == 0, half).otherwise(F.col("ts"))
    return d.table("events").select("event_id", stamp(clock.round_to_hour(t)).alias("hour"))


@query("pad_site_no", """
SELECT o_orderkey, CASE WHEN length(id) = 7 THEN '0' || id ELSE id END AS site_no
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(1000000 + o_orderkey AS STRING)
      ELSE CAST(10000000 + o_orderkey AS STRING) END AS id FROM orders)""")
def pad_site_no(d: Inputs) -> DataFrame:
    key = F.col("o_orderkey")
    site = F.when(key % 2 == 0, key + 1000000).otherwise(key + 10000000).cast("string")
    return d.table("orders").select("o_orderkey", text.pad_site_no(site).alias("site_no"))


@query("drop_quality_codes", "SELECT ord, datetime, cfs FROM iv_raw", ["iv_raw"])
def drop_quality_codes(d: Inputs) -> DataFrame:
    coded = d.view("iv_raw").withColumn("31_00060_cd", F.lit("A"))
    return clean.drop_quality_codes(coded)


@query("shift_offset_utc", """
SELECT event_id, strftime(ts - to_microseconds(CAST((-8 + (event_id % 8) * 0.5) * 3600000000 AS BIGINT)),
  '%Y-%m-%d %H:%M:%S') AS utc FROM events""")
def shift_offset_utc(d: Inputs) -> DataFrame:
    offset = F.lit(-8.0) + (F.col("event_id") % 8) * F.lit(0.5)
    return d.table("events").select("event_id", stamp(clock.shift_offset(F.col("ts"), offset)).alias("utc"))


@query("unit_conversions", """
SELECT event_id, round(value * 0.3048, 6) AS metres, round(value * 25.4, 6) AS mm,
       round((value - 32) * 5 / 9, 6) AS celsius, round(value * 0.5 + 10, 6) AS scaled FROM events""")
def unit_conversions(d: Inputs) -> DataFrame:
    v = F.col("value")
    return d.table("events").select(
        "event_id", F.round(numbers.feet_to_m(v), 6).alias("metres"), F.round(numbers.inches_to_mm(v), 6).alias("mm"),
        F.round(numbers.fahrenheit_to_c(v), 6).alias("celsius"), F.round(numbers.scaled(v, 0.5, 10.0), 6).alias("scaled"))


@query("clip_pet", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE greatest(value - 10, 0) END AS pet_mm_hr FROM events""")
def clip_pet(d: Inputs) -> DataFrame:
    v = F.when(F.col("event_id") % 9 != 0, F.col("value") - 10.0)
    return d.table("events").select("event_id", numbers.clip_low(v, 0.0).alias("pet_mm_hr"))


@query("snow_season", """
SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS day FROM (
  SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 20, INTERVAL 1 DAY)) AS day
  FROM orders)
WHERE month(day) >= 10 OR month(day) * 100 + day(day) <= 715""")
def snow_season(d: Inputs) -> DataFrame:
    periods = d.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"),
                                       F.date_add("o_orderdate", 20).alias("b"))
    return clean.season_days(periods, "a", "b").select("o_orderkey", F.col("day").cast("string").alias("day"))


@query("time_range", """
SELECT event_id, event_type FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""")
def time_range(d: Inputs) -> DataFrame:
    return clean.time_range(d.table("events"), "ts", "2024-01-05 00:00:00", "2024-01-12 12:00:00").select("event_id", "event_type")


_IMAGES = """
WITH timed AS (SELECT ord, strptime(regexp_extract(key, '___(.*)Z\\.jpg$', 1), '%Y-%m-%dT%H-%M-%S') AS t FROM camera_keys)
SELECT ord, 'day' AS chosen FROM timed WHERE CAST(t AS DATE) = DATE '2024-01-09'
UNION ALL SELECT ord, 'range' AS chosen FROM timed
WHERE t BETWEEN TIMESTAMP '2024-01-20 06:00:00' AND TIMESTAMP '2024-01-22 18:00:00'"""


@query("image_range_or_day", _IMAGES, ["camera_keys"])
def image_range_or_day(d: Inputs) -> DataFrame:
    images = scenes.camera_listing(d.view("camera_keys"))
    one = clean.image_range_or_day(images, "datetime", day="2024-01-09").select("ord", F.lit("day").alias("chosen"))
    many = clean.image_range_or_day(images, "datetime", start="2024-01-20 06:00:00", end="2024-01-22 18:00:00")
    return one.unionByName(many.select("ord", F.lit("range").alias("chosen")))


@query("cloud_filter", "SELECT ord FROM scenes WHERE cloud_percent <= 80 AND valid_fraction >= 0.05", ["scenes"])
def cloud_filter(d: Inputs) -> DataFrame:
    return clean.cloud_filter(d.view("scenes"), 80.0, 0.05).select("ord")


@query("station_record_floor", """
SELECT s.site_no, CASE WHEN km <= 330 THEN s.station_id END AS snotel_id, CASE WHEN km <= 330 THEN s.begin_date END AS snotel_begin
FROM (SELECT g.site_no, t.station_id, t.begin_date, 12742 * asin(sqrt(pow(sin(radians(t.lat - g.lat) / 2), 2)
  + cos(radians(g.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - g.lon) / 2), 2))) AS km
  FROM gauges g JOIN stations t ON t.ord = CAST(g.site_no AS BIGINT) - 10000000) s""", ["gauges", "stations"])
def station_record_floor(d: Inputs) -> DataFrame:
    from freshet.functions.geo import haversine_km

    s = d.view("stations").select("ord", "station_id", "begin_date", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    pairs = d.view("gauges").withColumn("ord", F.col("site_no").cast("bigint") - 10000000).join(s, "ord")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    kept = clean.station_record_floor(pairs, km, F.struct("station_id", "begin_date"))
    return kept.select("site_no", F.col("snotel.station_id").alias("snotel_id"), F.col("snotel.begin_date").alias("snotel_begin"))


@query("drop_incomplete", """
SELECT site_no, ord, round(p01m, 6) AS p01m, cfs FROM joined WHERE cfs IS NOT NULL AND mslp IS NOT NULL""", JOINED)
def drop_incomplete(d: Inputs) -> DataFrame:
    return clean.drop_incomplete(joined(d), ["cfs", "mslp"]).select("site_no", "ord", *rounded("p01m"), "cfs")


@query("tile_filter", """
SELECT ord, tile, CAST(tile = '13TDE' AS INT) AS single FROM (
  SELECT ord, CASE ord % 3 WHEN 0 THEN '13TDE' WHEN 1 THEN '13TDF' ELSE '12SVB' END AS tile FROM scenes)
WHERE tile IN ('13TDE', '12SVB')""", ["scenes"])
def tile_filter(d: Inputs) -> DataFrame:
    k = F.col("ord") % 3
    tiled = d.view("scenes").select("ord", F.when(k == 0, "13TDE").when(k == 1, "13TDF").otherwise("12SVB").alias("tile"))
    one = clean.tile_filter(tiled, "13TDE").select("ord", F.lit(1).alias("single"))
    return (clean.tile_filter(tiled, ["13TDE", "12SVB"]).join(one, "ord", "left")
            .select("ord", "tile", F.coalesce("single", F.lit(0)).alias("single")))


@query("calendar_split", """
SELECT site, strftime(date, '%Y-%m-%d') AS date, position, CASE WHEN position > 100 AND position <= 1000 THEN 'train'
  WHEN position > 1001 AND position <= 1300 THEN 'valid' WHEN position > 1300 AND position <= 1500 THEN 'test' END AS split
FROM (SELECT site, date, row_number() OVER (PARTITION BY site ORDER BY date) AS position FROM daily_flow
      WHERE date < DATE '2001-01-01')""", ["daily_flow"])
def calendar_split(d: Inputs) -> DataFrame:
    bands = {"train": (100, 1000), "valid": (1001, 1300), "test": (1300, 1500)}
    placed = clean.calendar_split(d.view("daily_flow"), ["site"], [F.col("date")], F.year("date"), bands,
                                  ts="date", cutoff="2001-01-01")
    return placed.select("site", F.col("date").cast("string").alias("date"), "position", "split")


@query("snow_states", """
SELECT o_orderkey, st FROM (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'CO' WHEN 1 THEN 'FL' WHEN 2 THEN 'UT'
  WHEN 3 THEN 'TX' ELSE 'PA' END AS st FROM orders) WHERE st IN ('CO', 'UT', 'PA')""")
def snow_states(d: Inputs) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("CO", "FL", "UT", "TX", "PA")])
    st = F.get(names, (F.col("o_custkey") % 5).cast("int"))
    return clean.snow_states(d.table("orders").select("o_orderkey", st.alias("st")), "st")
