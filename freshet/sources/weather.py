"""Weather tables, station lists, element series, forcing and snow series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from freshet import constants as K
from freshet.functions import numbers
from freshet.functions.text import triplet_parts
from freshet.sources.gauges import file_names

Paths = str | Sequence[str]
WEATHER_COLUMNS = ["station", "valid", "tmpf", "dwpf", "relh", "feel", "sknt", "sped", "alti", "mslp", "drct",
                   "ice_accretion_1hr", "p01m", "vsby", "gust", "skyc1", "peak_wind_gust", "snowdepth"]


def _paths(paths: Paths) -> str | list[str]:
    return paths if isinstance(paths, str) else list(paths)


def _text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_asos_csv(spark: SparkSession, paths: Paths, columns: Sequence[str] = WEATHER_COLUMNS) -> DataFrame:
    """Weather readings as text, because M and T mark missing and trace."""
    return spark.read.csv(_paths(paths), header=True, schema=_text_schema(columns), enforceSchema=False)


_FEATURES = ("features array<struct<geometry:struct<coordinates:array<double>>, properties:struct<"
             "sid:string, sname:string, elevation:double, archive_begin:string, online:boolean>>>")


def read_station_geojson(spark: SparkSession, paths: Paths, multi_line: bool = True) -> DataFrame:
    """Stations of feature collections, in file order (`ord`)."""
    docs = spark.read.schema(_FEATURES).json(_paths(paths), multiLine=multi_line)
    rows = docs.select(F.posexplode("features").alias("ord", "f"))
    return rows.select("ord", F.col("f.properties.sid").alias("station_id"), F.col("f.properties.sname").alias("name"),
                       F.get("f.geometry.coordinates", F.lit(1)).alias("lat"),
                       F.get("f.geometry.coordinates", F.lit(0)).alias("lon"),
                       F.col("f.properties.elevation").alias("elevation"),
                       F.col("f.properties.archive_begin").alias("archive_begin"),
                       F.col("f.properties.online").alias("online"))


_STATIONS = ("stationTriplet string, name string, latitude double, longitude double, elevation double, huc string,"
             " beginDate string, endDate string, dataTimeZone double, stationElements array<struct<"
             "elementCode:string, durationName:string, beginDate:string>>")
_OPEN_END = "2100-01-01"


def read_awdb_stations(spark: SparkSession, paths: Paths, network: str = "SCAN", state: str | None = None,
                       active_only: bool = True, multi_line: bool = True) -> DataFrame:
    """Stations of one network (and state); inactive ones have an end date in the past."""
    docs = spark.read.schema(_STATIONS).json(_paths(paths), multiLine=multi_line)
    parts = triplet_parts(F.col("stationTriplet"))
    kept = docs.filter(parts["network"] == network)
    if state:
        kept = kept.filter(parts["state"] == state)
    if active_only:
        kept = kept.filter(F.col("endDate").isNull() | (F.substring("endDate", 1, 10) >= _OPEN_END))
    return kept


def station_elements(stations: DataFrame) -> DataFrame:
    """Sensors of each station, one row each."""
    return stations.select(F.col("stationTriplet").alias("triplet"), F.inline("stationElements")).select(
        "triplet", F.col("elementCode").alias("element_code"), F.col("durationName").alias("duration"),
        F.col("beginDate").alias("begin_date"))


_ELEMENTS = ("stationTriplet string, data array<struct<stationElement:struct<elementCode:string, heightDepth:int>,"
             " values:array<struct<date:string, value:double>>>>")


def read_awdb_elements(spark: SparkSession, paths: Paths, multi_line: bool = True) -> DataFrame:
    """Element series as (triplet, column_name, date, value); buried sensors carry their depth in the name."""
    docs = spark.read.schema(_ELEMENTS).json(_paths(paths), multiLine=multi_line)
    blocks = docs.select(F.col("stationTriplet").alias("triplet"), F.inline("data"))
    depth = F.col("stationElement.heightDepth")
    name = F.when(depth.isNull(), F.col("stationElement.elementCode")).otherwise(
        F.concat(F.col("stationElement.elementCode"), F.lit("_"), depth.cast("string"), F.lit("in")))
    rows = blocks.select("triplet", name.alias("column_name"), F.inline("values"))
    return rows.select("triplet", "column_name", "date", "value")


def read_forcing_csv(spark: SparkSession, paths: Paths) -> DataFrame:
    """Forcing readings after a preamble of any length, as (file, datetime, value).

    Files are read as lines, so large ones split over tasks; data lines are those that begin with a time. A
    file without a header line (any case of `timestamp`) fails the query, also an empty one.
    """
    read = spark.read.text(_paths(paths))
    # An empty line for every file, so that files without lines are judged as well.
    lines = read.select(F.col("_metadata.file_path").alias("file"), "value").unionByName(
        file_names(read).withColumn("value", F.lit("")))
    marks = lines.groupBy("file").agg(F.count_if(F.lower("value").startswith("timestamp")).alias("_h"))
    # Judged on every line, so that a file without any data line fails as well.
    is_data = F.when(F.col("_h") > 0, F.col("value").rlike(r"^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}")).otherwise(
        F.raise_error(F.concat(F.lit("no timestamp header in "), F.col("file"))).cast("boolean"))
    cells = F.split("value", ",")
    stamp = F.try_to_timestamp(F.regexp_replace(F.trim(F.get(cells, F.lit(0))), "Z$", ""))
    reading = numbers.null_fill(numbers.to_number(F.get(cells, F.lit(1))), at_most=K.FORCING_FILL_MAX)
    return lines.join(marks, "file").filter(is_data).select("file", stamp.alias("datetime"), reading.alias("value"))


def read_gages_table(spark: SparkSession, paths: Paths, schema: str | T.StructType) -> DataFrame:
    """Attribute table in Latin-1; the gauge id stays text."""
    return spark.read.csv(_paths(paths), header=True, schema=schema, encoding="ISO-8859-1", enforceSchema=False)


def read_snotel_daily(spark: SparkSession, paths: Paths, columns: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Daily snow readings whose values all arrive as text; `Date` becomes a date, the rest numbers."""
    inner = ", ".join(f"`{c}`:string" for c in ["Date", *columns])
    schema = f"station_information struct<triplet:string>, data array<struct<{inner}>>"
    docs = spark.read.schema(schema).json(_paths(paths), multiLine=multi_line)
    rows = docs.select(F.col("station_information.triplet").alias("triplet"), F.inline("data"))
    return rows.select("triplet", F.to_date("Date").alias("Date"),
                       *[numbers.to_number(F.col(f"`{c}`")).alias(c) for c in columns])


def read_watershed_csv(spark: SparkSession, paths: Paths) -> DataFrame:
    """Watershed snow table: columns by position, US dates, inches to millimetres."""
    names = ["datetime", "wy_precip_mm", "swe_mm"]
    raw = spark.read.csv(_paths(paths), header=True, schema=_text_schema(names))

    def mm(column: str) -> Column:
        return numbers.inches_to_mm(numbers.to_number(F.col(column))).alias(column)

    return raw.select(F.try_to_timestamp("datetime", F.lit("MM/dd/yyyy")).alias("datetime"), mm("swe_mm"),
                      mm("wy_precip_mm"))


_META = ("id string, latitude double, logitude double, name string, state string, timeZoneInfo string,"
         " elevation struct<results:array<struct<elevation:double, resolution:double>>>,"
         " soil_data struct<properties:struct<layers:array<struct<name:string, depths:array<struct<label:string,"
         " values:map<string,double>>>>>>>,"
         " stations array<struct<station_id:string, distance:double, missing_precip:bigint, missing_temp:bigint>>,"
         " time_zone_code string, max_flow double, min_flow double, nan_flow bigint, nan_precip bigint,"
         " files array<string>")


def read_gauge_meta(spark: SparkSession, paths: Paths, multi_line: bool = True) -> DataFrame:
    """Nested gauge documents: one row per gauge with padded id, first elevation, stations and soil layers."""
    from freshet.functions.text import pad_site_no

    docs = spark.read.schema(_META).json(_paths(paths), multiLine=multi_line)
    return docs.select(pad_site_no(F.col("id")).alias("site_no"), F.col("latitude").alias("lat"),
                       F.col("logitude").alias("lon"), "name", "state",
                       F.get("elevation.results", F.lit(0))["elevation"].alias("elevation_m"), "stations",
                       F.col("soil_data.properties.layers").alias("soil_layers"), "time_zone_code", "max_flow",
                       "min_flow", "nan_flow", "nan_precip", "files")


def soil_values(meta: DataFrame) -> DataFrame:
    """Soil readings of gauge documents, one row per layer, depth and statistic."""
    layers = meta.select("site_no", F.inline("soil_layers"))
    depths = layers.select("site_no", F.col("name").alias("layer"), F.inline("depths"))
    return depths.select("site_no", "layer", F.col("label").alias("depth"), F.explode("values").alias("statistic", "value"))
