"""Spark frames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.catalog.registry import Inputs
from freshet.operators import joins, rollups
from freshet.plans.catchments import usgs_to_hourly_utc


def flow_hourly(d: Inputs) -> DataFrame:
    return usgs_to_hourly_utc(d.view("iv_raw"))


def weather_hourly(d: Inputs, view: str = "asos_fall") -> DataFrame:
    return rollups.hourly_weather(d.view(view), ["station"], "ord")


def named_site(weather: DataFrame) -> DataFrame:
    number = F.substring("station", 2, 3).cast("bigint")
    return weather.withColumn("site_no", F.lpad((number + 10000000).cast("string"), 8, "0"))


def with_site(weather: DataFrame) -> DataFrame:
    """Weather of the stations that have a gauge."""
    return named_site(weather.filter(F.substring("station", 2, 3).cast("bigint") < 12))


def weather_site(d: Inputs) -> DataFrame:
    return with_site(weather_hourly(d))


def joined(d: Inputs) -> DataFrame:
    return joins.weather_flow_inner(weather_site(d), flow_hourly(d))


def snow_cells(d: Inputs) -> DataFrame:
    """The snow grid with its fill values removed."""
    return d.view("cells").withColumn(
        "swe_mm", F.when(F.col("swe_raw") != -9999, F.col("swe_raw").cast("double"))).withColumn(
        "elevation_m", F.col("elevation_m").cast("double"))


def hourly_iv(d: Inputs) -> DataFrame:
    """Hourly readings of three gauges: every order line reports through its day, with some hours left out."""
    lines = d.table("lineitem").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    value = (F.col("l_quantity") + (F.col("h") * 7 + F.col("l_linenumber")) % 11).cast("double")
    return lines.filter((F.col("l_partkey") + F.col("h")) % 17 != 0).select(
        (F.col("l_suppkey") % 3).alias("site"),
        F.timestamp_add("HOUR", F.col("h"), F.to_date("l_shipdate").cast("timestamp")).alias("datetime"),
        F.when((F.col("l_orderkey") + F.col("h")) % 29 != 0, value).alias("cfs"))
