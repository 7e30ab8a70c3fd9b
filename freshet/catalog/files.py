"""Queries of readers and writers: files are derived from the given tables, written, and read back."""

from __future__ import annotations

import gzip
import io
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from freshet import sinks
from freshet.catalog.aggregates import SERIES, series_rows
from freshet.catalog.frames import flow_hourly, weather_site
from freshet.catalog.registry import Inputs, query, rounded, stamp
from freshet.catalog.views import FLOW, JOINED
from freshet.catalog.windows import MIN_OBSERVED, PANEL, WIDTH, panel, steps
from freshet.operators import clean, joins, panels
from freshet.operators.spatial import bbox
from freshet.plans.catchments import usgs_to_hourly_utc
from freshet.sources import gauges as gauge_files, grids, weather as weather_files


def _tab(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def write_tab_files(d: Inputs, rows: DataFrame, header: list[str], label: str) -> str:
    """Tab-separated files with comment, header and format lines, several files of bounded share each."""
    path = d.scratch(label)
    lead = ["# Data are provisional", "#    TS   Parameter Description", "#", "\t".join(header), "\t".join(["15s"] * len(header))]
    heads = rows.select("part").distinct().withColumn("value", F.explode(F.array(*[F.lit(x) for x in lead])))
    rows.select("part", "value").unionByName(heads).repartition("part").write.partitionBy("part").text(path)
    return path


IV_HEADER = ["agency_cd", "site_no", "datetime", "tz_cd", "31_00060", "31_00060_cd", "32_00065", "32_00065_cd"]


def gauge_readings(d: Inputs) -> DataFrame:
    """All readings, written as gauge files and read back; the second series holds the order of the rows."""
    rows = d.view("iv_raw").select(F.concat_ws("-", "site_no", (F.col("ord") % 4).cast("string")).alias("part"), _tab(
        F.lit("USGS"), "site_no", "datetime", "tz_cd", "cfs", F.lit("A"), F.col("ord").cast("string"), F.lit("A")).alias("value"))
    return gauge_files.read_rdb_iv(d.spark, write_tab_files(d, rows, IV_HEADER, "iv"))


@query("read_rdb_iv", """SELECT site_no, datetime, tz_cd, cfs, CAST(ord AS STRING) AS height, 'A' AS code FROM iv_raw""", ["iv_raw"])
def read_rdb_iv(d: Inputs) -> DataFrame:
    code = F.try_element_at("values", F.lit("31_00060_cd"))
    return clean.rename_by_param(gauge_readings(d).withColumn("code", code)).select("site_no", "datetime", "tz_cd", "cfs", "height", "code")


@query("files_to_bundle", """
SELECT site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, ord, cfs, round(p01m, 6) AS p01m, round(tmpf, 6) AS tmpf FROM joined""", JOINED)
def files_to_bundle(d: Inputs) -> DataFrame:
    """From gauge files to the written bundle: read, rename, UTC hours, weather of the hour, hourly files."""
    raw = clean.rename_by_param(gauge_readings(d)).withColumn("ord", F.col("height").cast("bigint"))
    bundle = joins.weather_flow_inner(weather_site(d), usgs_to_hourly_utc(raw))
    path = d.scratch("bundle")
    sinks.write_hourly(bundle, path)
    back = d.spark.read.parquet(path)
    return back.select(F.lpad(F.col("site_no").cast("string"), 8, "0").alias("site_no"), stamp("hour_updated").alias("hour_updated"), "ord", "cfs", *rounded("p01m", "tmpf"))


SITE_HEADER = ["agency_cd", "site_no", "station_nm", "dec_lat_va", "dec_long_va", "alt_va", "drain_area_va",
               "contrib_drain_area_va", "state_cd", "huc_cd"]


def site_rows(d: Inputs) -> DataFrame:
    g = d.view("gauges").withColumn("n", F.col("site_no").cast("bigint") - 10000000)
    area = F.when(F.col("n") % 3 == 0, F.lit("--")).otherwise((F.col("n") * 2).cast("string"))
    agency = F.when(F.col("n") % 11 == 10, "CODWR").otherwise("USGS")
    return g.select((F.col("n") % 8).alias("part"), _tab(
        agency, "site_no", "station_nm", F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("n").cast("string"), area,
        F.lit(""), F.col("state_cd").cast("string"), F.lit("10190007")).alias("value"))


@query("read_rdb_site", """
SELECT site_no, station_nm, CAST(state_cd AS STRING) AS state_cd, lat AS dec_lat_va, lon AS dec_long_va, CAST(n AS DOUBLE) AS alt_va,
  CASE WHEN n % 3 <> 0 THEN CAST(n * 2 AS DOUBLE) END AS drain_area_va, CAST(NULL AS DOUBLE) AS contrib_drain_area_va
FROM (SELECT *, CAST(site_no AS BIGINT) - 10000000 AS n FROM gauges)""", ["gauges"])
def read_rdb_site(d: Inputs) -> DataFrame:
    out = gauge_files.read_rdb_site(d.spark, write_tab_files(d, site_rows(d), SITE_HEADER, "site"))
    return out.select("site_no", "station_nm", "state_cd", *gauge_files.SITE_NUMERIC)


@query("read_rdb_catalog", f"SELECT site_no, data_type_cd, parm_cd, begin_date, end_date, count_nu FROM ({SERIES}) WHERE parm_cd <> '' AND ord % 13 <> 0")
def read_rdb_catalog(d: Inputs) -> DataFrame:
    header = ["agency_cd", "site_no", "data_type_cd", "parm_cd", "begin_date", "end_date", "count_nu"]
    s = series_rows(d)
    full = _tab(F.lit("USGS"), *header[1:])
    # Some rows are cut short, as the service sometimes does.
    rows = s.select(F.concat_ws("-", "site_no", (F.col("ord") % 2).cast("string")).alias("part"), F.when(
        F.col("ord") % 13 == 0, _tab(F.lit("USGS"), "site_no", "data_type_cd")).otherwise(full).alias("value"))
    return gauge_files.read_rdb_catalog(d.spark, write_tab_files(d, rows, header, "catalog"))


@query("read_state_gauges", """
SELECT site_no, station_nm, lat AS dec_lat_va, lon AS dec_long_va, '10190007' AS huc_cd FROM gauges WHERE (CAST(site_no AS BIGINT) - 10000000) % 11 <> 10""", ["gauges"])
def read_state_gauges(d: Inputs) -> DataFrame:
    out = gauge_files.read_state_gauges(d.spark, write_tab_files(d, site_rows(d), SITE_HEADER, "state"))
    return out.select("site_no", "station_nm", F.col("dec_lat_va").cast("double"), F.col("dec_long_va").cast("double"), "huc_cd")


@query("read_daily_values", """SELECT CAST(site AS STRING) AS site_no, strftime(date, '%Y-%m-%d') AS date, CASE WHEN CAST(cfs AS BIGINT) % 9 <> 0 THEN cfs END AS cfs FROM daily_flow""", ["daily_flow"])
def read_daily_values(d: Inputs) -> DataFrame:
    flow = d.view("daily_flow")
    reading = F.struct(F.when(F.col("cfs").cast("bigint") % 9 == 0, F.lit(-999999.0)).otherwise(F.col("cfs")).cast("string").alias("value"),
                       F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000")).alias("dateTime"))
    # One response covers one site and year.
    docs = flow.groupBy(F.col("site").cast("string").alias("s"), F.year("date")).agg(F.collect_list(reading).alias("v"))
    series = F.struct(F.struct(F.array(F.struct(F.col("s").alias("value"))).alias("siteCode")).alias("sourceInfo"),
                      F.struct(F.lit(-999999.0).alias("noDataValue")).alias("variable"),
                      F.array(F.struct(F.col("v").alias("value"))).alias("values"))
    path = d.scratch("daily-values")
    docs.select(F.to_json(F.struct(F.struct(F.array(series).alias("timeSeries")).alias("value"))).alias("value")).write.text(path)
    out = gauge_files.read_daily_values(d.spark, path, multi_line=False)
    return out.select("site_no", F.col("date").cast("string").alias("date"), "cfs")


@query("read_asos_csv", "SELECT station, valid, tmpf, dwpf, p01m, mslp, skyc1 FROM asos_raw", ["asos_raw"])
def read_asos_csv(d: Inputs) -> DataFrame:
    columns = ["station", "valid", "tmpf", "dwpf", "p01m", "mslp", "skyc1"]
    path = d.scratch("asos")
    d.view("asos_raw").select(*columns).write.csv(path, header=True)
    return weather_files.read_asos_csv(d.spark, path, columns)


@query("read_station_geojson", """
SELECT station_id, 'Station ' || station_id AS name, lat, lon, CAST(ord % 3000 AS DOUBLE) AS elevation, CASE WHEN ord % 5 > 0 THEN begin_date END AS archive_begin, ord % 2 = 0 AS online FROM stations""", ["stations"])
def read_station_geojson(d: Inputs) -> DataFrame:
    feature = F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(
        F.col("station_id").alias("sid"), F.concat(F.lit("Station "), "station_id").alias("sname"), (F.col("ord") % 3000).cast("double").alias("elevation"),
        F.when(F.col("ord") % 5 > 0, F.col("begin_date")).alias("archive_begin"), (F.col("ord") % 2 == 0).alias("online")).alias("properties"))
    path = d.scratch("geojson")
    groups = d.view("stations").groupBy("state_cd", F.floor(F.col("ord") / 500)).agg(F.collect_list(feature).alias("features"))
    groups.select(F.to_json(F.struct("features")).alias("value")).write.text(path)
    return weather_files.read_station_geojson(d.spark, path, multi_line=False).drop("ord")


def awdb_docs(d: Inputs) -> str:
    n = F.col("c_custkey")
    network = F.when(n % 2 == 0, "SCAN").otherwise("SNTL")
    triplet = F.concat(n.cast("string"), F.lit(":"), F.when(n % 3 == 0, "CO").otherwise("UT"), F.lit(":"), network)
    sensors = F.array(*[F.struct(F.lit(code).alias("elementCode"), F.lit(name).alias("durationName"), F.concat(
        (n % 30 + year).cast("string"), F.lit("-01-01 00:00")).alias("beginDate")) for code, name, year in
        (("SMS", "HOURLY", 1990), ("SMS", "DAILY", 1980), ("WTEQ", "DAILY", 1970))])
    path = d.scratch("awdb-stations")
    d.table("customer").select(F.to_json(F.struct(
        triplet.alias("stationTriplet"), F.col("c_name").alias("name"), (n % 100 / F.lit(10.0)).alias("latitude"), (-n % 100 / F.lit(10.0)).alias("longitude"),
        n.cast("double").alias("elevation"), F.when(n % 7 == 0, "2010-01-01 00:00").otherwise("2100-01-01 00:00").alias("endDate"),
        F.lit(-8.0).alias("dataTimeZone"), sensors.alias("stationElements"))).alias("value")).write.text(path)
    return path


@query("read_awdb_stations", """
SELECT CAST(c_custkey AS STRING) || ':CO:SCAN' AS triplet, c_name AS name, CAST(1990 + c_custkey % 30 AS STRING) || '-01-01' AS sms_begin
FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0 AND c_custkey % 7 <> 0""")
def read_awdb_stations(d: Inputs) -> DataFrame:
    from freshet.operators.rollups import element_begin

    found = weather_files.read_awdb_stations(d.spark, awdb_docs(d), "SCAN", "CO", multi_line=False)
    begins = element_begin(weather_files.station_elements(found)).withColumnRenamed("element_begin", "sms_begin")
    return found.select(F.col("stationTriplet").alias("triplet"), "name").join(begins, "triplet")


@query("read_awdb_elements", """
SELECT CAST(user_id % 20 AS STRING) || ':CO:SCAN' AS triplet, CASE event_id % 3 WHEN 0 THEN 'SMS_-2in' WHEN 1 THEN 'SMS_-8in' ELSE 'WTEQ' END AS column_name,
  substr(CAST(ts AS STRING), 1, 16) AS date, value FROM events""")
def read_awdb_elements(d: Inputs) -> DataFrame:
    e = d.table("events")
    n = F.col("event_id") % 3
    rows = e.select((F.col("user_id") % 20).alias("s"), F.when(n == 2, "WTEQ").otherwise("SMS").alias("code"), F.when(n == 0, -2).when(n == 1, -8).alias("depth"),
                    F.to_date("ts").alias("day"), F.struct(F.substring(F.col("ts").cast("string"), 1, 16).alias("date"), "value").alias("v"))
    blocks = rows.groupBy("s", "day", "code", "depth").agg(F.collect_list("v").alias("values"))
    data = F.array(F.struct(F.struct(F.col("code").alias("elementCode"), F.col("depth").alias("heightDepth")).alias("stationElement"), "values"))
    path = d.scratch("awdb-elements")
    blocks.select(F.to_json(F.struct(F.concat(F.col("s").cast("string"), F.lit(":CO:SCAN")).alias("stationTriplet"), data.alias("data"))).alias("value")).write.text(path)
    return weather_files.read_awdb_elements(d.spark, path, multi_line=False)


@query("read_forcing_csv", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, CASE WHEN event_id % 8 <> 0 THEN value END AS value FROM events""")
def read_forcing_csv(d: Inputs) -> DataFrame:
    line = F.concat_ws(",", stamp("ts"), F.when(F.col("event_id") % 8 == 0, F.lit("-9999")).otherwise(F.col("value").cast("string")))
    rows = d.table("events").select((F.col("event_id") % 10).alias("part"), line.alias("value"))
    lead = ["prod_name,NLDAS_FORA0125_H_2_0_Tair", "begin_time,2024-01-01", "lat,40.5", "", "Timestamp (UTC),Data"]
    heads = rows.select("part").distinct().withColumn("value", F.explode(F.array(*[F.lit(x) for x in lead])))
    path = d.scratch("forcing")
    rows.unionByName(heads).repartition("part").write.partitionBy("part").text(path)
    return weather_files.read_forcing_csv(d.spark, path).select(stamp("datetime").alias("datetime"), "value")


@query("read_gages_tables", """
SELECT lpad(CAST(p_partkey + 1000000 AS STRING), 8, '0') AS staid, p_name || ' Cañón' AS name, p_size AS slope_pct, p_retailprice AS drain_sqkm FROM part""")
def read_gages_tables(d: Inputs) -> DataFrame:
    path = d.scratch("attributes")
    d.table("part").select(F.lpad((F.col("p_partkey") + 1000000).cast("string"), 8, "0").alias("STAID"), F.concat("p_name", F.lit(" Cañón")).alias("NAME"),
                           F.col("p_size").alias("SLOPE_PCT"), F.col("p_retailprice").alias("DRAIN_SQKM")).write.csv(path, header=True, encoding="ISO-8859-1")
    out = weather_files.read_gages_table(d.spark, path, "STAID string, NAME string, SLOPE_PCT int, DRAIN_SQKM double")
    return out.select(F.col("STAID").alias("staid"), F.col("NAME").alias("name"), F.col("SLOPE_PCT").alias("slope_pct"), F.col("DRAIN_SQKM").alias("drain_sqkm"))


@query("read_snotel_daily", """
SELECT CAST(o_custkey % 40 AS STRING) || ':CO:SNTL' AS triplet, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS depth FROM orders""")
def read_snotel_daily(d: Inputs) -> DataFrame:
    n = F.col("o_orderkey")
    reading = F.struct(F.col("o_orderdate").cast("date").cast("string").alias("Date"), F.when(n % 9 != 0, (n % 100).cast("string")).otherwise("").alias("Snow Depth (in)"))
    docs = d.table("orders").groupBy((F.col("o_custkey") % 40).alias("s"), F.year("o_orderdate"), (n % 4)).agg(F.collect_list(reading).alias("data"))
    path = d.scratch("snotel")
    docs.select(F.to_json(F.struct(F.struct(F.concat(F.col("s").cast("string"), F.lit(":CO:SNTL")).alias("triplet")).alias("station_information"), "data")).alias("value")).write.text(path)
    out = weather_files.read_snotel_daily(d.spark, path, ["Snow Depth (in)"], multi_line=False)
    return out.select("triplet", F.col("Date").cast("string").alias("day"), F.col("`Snow Depth (in)`").alias("depth"))


@query("read_watershed_csv", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round((o_orderkey % 80) * 25.4, 6) AS swe_mm, CASE WHEN o_orderkey % 6 <> 0 THEN round((o_orderkey % 50) * 25.4, 6) END AS wy_precip_mm FROM orders""")
def read_watershed_csv(d: Inputs) -> DataFrame:
    n = F.col("o_orderkey")
    path = d.scratch("watershed")
    d.table("orders").select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date"), F.when(n % 6 == 0, "n/a").otherwise((n % 50).cast("string")).alias("WY Precip"),
                             (n % 80).cast("string").alias("SWE")).write.csv(path, header=True)
    out = weather_files.read_watershed_csv(d.spark, path)
    return out.select(F.date_format("datetime", "yyyy-MM-dd").alias("day"), *rounded("swe_mm", "wy_precip_mm"))


_COLS, _ROWS = 50, 40


def _pack(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """One daily archive of a bounded strip of the grid."""
    import numpy as np

    day, strip = key
    grid = np.full((_ROWS, _COLS), -9999, dtype=">i2")
    grid[cells["row"] - strip * _ROWS, cells["col"]] = cells["raw"]
    header = "\n".join([
        "Format version: v1.1", "Data units: Meters / 1000.000000", "Data intercept: 0.0", "Data slope: 1.0", f"Number of columns: {_COLS}", f"Number of rows: {_ROWS}",
        "Benchmark x-axis coordinate: -106.0", f"Benchmark y-axis coordinate: {41 - strip * _ROWS / 40}", "X-axis resolution: 0.025", "Y-axis resolution: 0.025",
        f"Start year: {day.year}", f"Start month: {day.month}", f"Start day: {day.day}"])
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, content in (("us_ssmv11036.dat.gz", b"other"), ("us_ssmv11034tS.dat.gz", grid.tobytes()), ("us_ssmv11034tS.txt.gz", header.encode())):
            packed = gzip.compress(content, 1)
            info = tarfile.TarInfo(name)
            info.size = len(packed)
            archive.addfile(info, io.BytesIO(packed))
    return pd.DataFrame({"name": [f"SNODAS_{day:%Y%m%d}_strip{strip}.tar"], "content": [out.getvalue()]})


@query("snow_tars_to_cells", """
SELECT CAST(n AS BIGINT) AS day, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN swe_raw <> -9999 THEN CAST(swe_raw + n AS DOUBLE) END AS swe_mm FROM cells, range(3) t(n)""", ["cells"])
def snow_tars_to_cells(d: Inputs) -> DataFrame:
    days = d.view("cells").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    strips = days.select(F.date_add(F.lit("2024-02-01").cast("date"), F.col("n")).alias("day"), F.floor(F.col("row") / _ROWS).alias("strip"), "row", "col",
                         F.when(F.col("swe_raw") == -9999, -9999).otherwise(F.col("swe_raw") + F.col("n")).alias("raw"))
    path = d.scratch("archives")
    sinks.write_files(strips.groupBy("day", "strip").applyInPandas(_pack, "name string, content binary"), path)
    cells = grids.check_grid(grids.snow_tars_to_cells(d.spark, path), (_ROWS, _COLS))
    # The last strip may reach below the grid; those cells hold only fill.
    rows = d.view("cells").select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    out = cells.select(F.datediff("date", F.lit("2024-02-01").cast("date")).cast("bigint").alias("day"), *rounded("lat", "lon"), "swe_mm")
    return out.join(rows, ["lat", "lon"], "left_semi")


@query("read_day_maps", """
SELECT CAST(o_custkey % 50 AS STRING) AS site_no, strftime(o_orderdate, '%Y-%m-%d') AS datetime, CASE WHEN min(o_orderkey) % 5 <> 0 THEN CAST(min(o_orderkey) AS DOUBLE) END AS snodas_swe_mm
FROM orders WHERE day(o_orderdate) <> 13 GROUP BY 1, 2""")
def read_day_maps(d: Inputs) -> DataFrame:
    best = d.table("orders").groupBy(F.col("o_orderdate").alias("t"), (F.col("o_custkey") % 50).cast("string").alias("s")).agg(F.min("o_orderkey").alias("k"))
    entry = F.concat(F.lit('"'), "s", F.lit('": '), F.when(F.col("k") % 5 == 0, "NaN").otherwise(F.col("k").cast("string")))
    docs = best.groupBy("t").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("body"))
    texts = docs.select(F.concat(F.date_format("t", "yyyyMMdd"), F.lit(".json")).alias("file"),
                        F.when(F.dayofmonth("t") == 13, '{"missing": true}').otherwise(F.col("body")).alias("value"))
    path = d.scratch("maps")
    sinks.write_files(texts.select(F.col("file").alias("name"), F.encode("value", "UTF-8").alias("content")), path)
    out = grids.read_day_maps(d.spark, path)
    return out.select("site_no", F.col("datetime").cast("string").alias("datetime"), "snodas_swe_mm")


@query("read_gauge_meta", """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN '0' || CAST(1000000 + s_suppkey AS STRING) ELSE CAST(10000000 + s_suppkey AS STRING) END AS site_no, s_name AS name, s_acctbal AS elevation_m,
  'K' || CAST(s_suppkey % 7 AS STRING) AS station_id, CAST(s_suppkey AS DOUBLE) / 4 AS distance, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS DOUBLE) END AS clay FROM supplier""")
def read_gauge_meta(d: Inputs) -> DataFrame:
    n = F.col("s_suppkey")
    layers = F.array(F.struct(F.lit("clay").alias("name"), F.array(F.struct(F.lit("0-5cm").alias("label"), F.create_map(
        F.lit("mean"), F.when(n % 3 > 0, n.cast("double"))).alias("values"))).alias("depths")))
    doc = F.struct(F.when(n % 2 == 0, n + 1000000).otherwise(n + 10000000).cast("string").alias("id"), F.lit(40.0).alias("latitude"), F.lit(-105.0).alias("logitude"),
                   F.col("s_name").alias("name"), F.lit("CO").alias("state"), F.struct(F.array(F.struct(F.col("s_acctbal").alias("elevation"))).alias("results")).alias("elevation"),
                   F.array(F.struct(F.concat(F.lit("K"), (n % 7).cast("string")).alias("station_id"), (n / F.lit(4.0)).alias("distance"))).alias("stations"),
                   F.struct(F.struct(layers.alias("layers")).alias("properties")).alias("soil_data"))
    path = d.scratch("meta")
    d.table("supplier").select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    meta = weather_files.read_gauge_meta(d.spark, path, multi_line=False)
    soil = weather_files.soil_values(meta).select("site_no", F.col("value").alias("clay"))
    return meta.select("site_no", "name", "elevation_m", F.inline("stations")).join(soil, "site_no").select("site_no", "name", "elevation_m", "station_id", "distance", "clay")


_BOXED = """SELECT site_no, round(lon - 0.4, 6) AS min_lon, round(lat - 0.3, 6) AS min_lat, round(lon + 0.4, 6) AS max_lon, round(lat + 0.3, 6) AS max_lat FROM gauges"""


def gauge_outlines(d: Inputs) -> DataFrame:
    """A box around every gauge as its outline."""
    from freshet.catalog.linking import gauge_boxes

    corners = [("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat")]
    ring = F.array(*[F.array(x, y) for x, y in corners])
    return gauge_boxes(d).select("site_no", F.array(F.array(ring)).alias("polygons"))


def outlines_back(d: Inputs, label: str) -> DataFrame:
    path = d.scratch(label)
    sinks.write_basins(gauge_outlines(d), path)
    return grids.read_basins(d.spark, path, one_per_line=True)


@query("read_basins", _BOXED, ["gauges"])
def read_basins(d: Inputs) -> DataFrame:
    """Outlines in the three accepted forms: bare geometry, feature, and one-feature collection."""
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get("polygons", F.lit(0)).alias("coordinates")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":{"site_no":"'), "site_no", F.lit('"}}'))
    kind = F.col("site_no").cast("bigint") % 2
    text = F.when(kind == 0, feature).otherwise(F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")))
    path = d.scratch("outlines")
    gauge_outlines(d).select(text.alias("value")).write.text(path)
    read = grids.read_basins(d.spark, path, one_per_line=True)
    return read.select("site_no", F.inline(F.array(bbox(F.col("polygons"))))).select("site_no", *rounded("min_lon", "min_lat", "max_lon", "max_lat"))


def _png(pixels: bytes, side: int = 16) -> bytes:
    """A small image file of bytes in the order blue, green, red."""
    import struct
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rgb = b"".join(pixels[i:i + 3][::-1] for i in range(0, len(pixels), 3))
    lines = b"".join(b"\0" + rgb[i:i + 3 * side] for i in range(0, len(rgb), 3 * side))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


@query("dem_tiles_to_pixels", """
WITH k AS (SELECT unnest(range((max(p_partkey) // 256 + 1) * 256)) AS k FROM part)
SELECT CAST(190 * 16 + (k % 256) // 16 AS BIGINT) AS row, CAST((k // 256 + 100) * 16 + k % 16 AS BIGINT) AS col,
  coalesce(CAST(k % 200 * 256 + p_size AS DOUBLE) + CAST(k % 128 AS DOUBLE) / 256, 0) - 32768 AS elevation_m
FROM k LEFT JOIN part ON p_partkey = k""")
def dem_tiles_to_pixels(d: Inputs) -> DataFrame:
    """Tiles of 16 by 16 pixels, each made of 256 parts; places without a part are black."""
    k = F.col("p_partkey")
    pixel = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (k % 128, F.col("p_size").cast("bigint"), k % 200)])
    tiles = d.table("part").groupBy(F.floor(k / 256).alias("t")).agg(F.map_from_entries(F.collect_list(F.struct((k % 256).alias("k"), pixel.alias("b")))).alias("px"))
    places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint")), lambda i: F.coalesce(F.try_element_at("px", i), F.lit("000000")))
    path = d.scratch("tiles")
    png = F.udf(_png, "binary")
    sinks.write_files(tiles.select(F.concat(F.lit("9/"), (F.col("t") + 100).cast("string"), F.lit("/190.png")).alias("name"),
                                   png(F.unhex(F.array_join(places, ""))).alias("content")), path)
    out = grids.dem_tiles_to_pixels(d.spark, path, 9, (-180.0, -90.0, 180.0, 90.0), tile_size=16)
    return out.select("row", "col", "elevation_m")


def state_records(d: Inputs) -> DataFrame:
    return d.view("registry").select("site_no", "status", "state")


@query("combine_states", "SELECT state, status, count(*) AS n FROM registry WHERE state IN (3, 7, 11, 49) GROUP BY 1, 2", ["registry"])
def combine_states(d: Inputs) -> DataFrame:
    path = d.scratch("states")
    state_records(d).write.partitionBy("state").parquet(path)
    read = grids.combine_states(d.spark, path, [3, 7, 11, 49])
    return read.groupBy(F.col("state").cast("bigint").alias("state"), "status").agg(F.count(F.lit(1)).alias("n"))


# Writers: write, read back, compare with the source.
@query("write_hourly", "SELECT site_no, ord, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, cfs FROM flow_hourly", FLOW)
def write_hourly(d: Inputs) -> DataFrame:
    path = d.scratch("hourly")
    sinks.write_hourly(flow_hourly(d).withColumn("state", F.lit("CO")), path)
    back = d.spark.read.option("basePath", path).parquet(path).filter(F.col("state") == "CO")
    return back.select("site_no", "ord", stamp("hour_updated").alias("hour_updated"), "cfs")


@query("write_static", "SELECT site_no, station_nm, lat, lon FROM gauges", ["gauges"])
def write_static(d: Inputs) -> DataFrame:
    path = d.scratch("static")
    sinks.write_static(d.view("gauges"), path)
    return d.spark.read.schema("site_no string, station_nm string, lat double, lon double").json(path)


@query("write_basins", _BOXED, ["gauges"])
def write_basins(d: Inputs) -> DataFrame:
    back = outlines_back(d, "features")
    return back.select("site_no", F.inline(F.array(bbox(F.col("polygons"))))).select("site_no", *rounded("min_lon", "min_lat", "max_lon", "max_lat"))


@query("write_series", "SELECT site AS site_no, strftime(date, '%Y-%m-%d') AS datetime, cfs FROM daily_flow", ["daily_flow"])
def write_series(d: Inputs) -> DataFrame:
    path = d.scratch("series")
    sinks.write_series(d.view("daily_flow").select(F.col("site").alias("site_no"), F.col("date").alias("datetime"), "cfs"), path)
    back = d.spark.read.parquet(path)
    return back.select(F.col("site_no").cast("bigint").alias("site_no"), F.col("datetime").cast("string").alias("datetime"), "cfs")


@query("write_manifest", "SELECT ord, product_id, cloud_percent FROM scenes", ["scenes"])
def write_manifest(d: Inputs) -> DataFrame:
    path = d.scratch("manifest")
    listed = d.view("scenes").select("ord", "product_id", "cloud_percent")
    for part in (0, 1):  # two runs append to one manifest
        sinks.write_manifest(listed.filter(F.col("ord") % 2 == part), path)
    return d.spark.read.csv(path, header=True, schema="ord bigint, product_id string, cloud_percent bigint")


@query("write_warehouse", "SELECT site_no, ord, cfs FROM flow_hourly UNION ALL SELECT site_no, ord, cfs FROM flow_hourly", FLOW)
def write_warehouse(d: Inputs) -> DataFrame:
    import uuid

    table = f"hourly_{uuid.uuid4().hex[:12]}"
    path = d.scratch("warehouse")
    flow = flow_hourly(d).select("site_no", "ord", "cfs")
    for _ in range(2):
        sinks.write_warehouse(flow, table, path)
    return d.spark.table(table)


@query("write_panels", f"""WITH {PANEL}
SELECT p.site, slice_order, slice_type, count(f.cfs) AS known, CAST(sum(f.cfs) AS DOUBLE) AS total FROM panel p LEFT JOIN daily_flow f ON f.site = p.site AND f.date BETWEEN p.start AND p.start + 91 GROUP BY ALL""", ["daily_flow"])
def write_panels(d: Inputs) -> DataFrame:
    s = steps(d)
    built = panels.build_panels(s.select("site").distinct(), s, s.select("site").limit(0), WIDTH, "day", MIN_OBSERVED, "site")
    path = d.scratch("panels")
    sinks.write_panels(built, path)
    back = d.spark.read.parquet(path).select("site", F.inline("panel"))
    return back.select("site", "slice_order", "slice_type", F.size(F.filter("values", lambda x: x.isNotNull())).cast("bigint").alias("known"), F.aggregate(
        "values", F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)).cast("double")).alias("total"))


@query("write_registry", """
SELECT o_custkey % 500 AS site_no, arg_max(o_orderstatus, o_orderkey) AS status, CAST(max(o_orderkey) AS BIGINT) AS rows FROM orders GROUP BY 1""")
def write_registry(d: Inputs) -> DataFrame:
    path = d.scratch("registry")
    empty = sinks.read_registry(d.spark, path)
    o = d.table("orders").select((F.col("o_custkey") % 500).cast("string").alias("site_no"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("rows"),
                                 F.lit(None).cast("string").alias("error"), F.timestamp_seconds("o_orderkey").alias("finished_at"))
    sinks.write_registry(empty, path)
    for part in (0, 1, 2):
        sinks.write_registry(o.filter(F.col("rows") % 3 == part), path)
    out = sinks.read_registry(d.spark, path)
    return out.select(F.col("site_no").cast("bigint").alias("site_no"), "status", "rows")
