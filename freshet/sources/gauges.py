"""Tab-separated gauge files: readings, site rows, series catalogues, state lists; daily values in JSON.

Files are read as lines, so large ones split over tasks. Their header lines are few (one or a handful per
file) and joined back by file name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from freshet.functions.numbers import to_number

SITE_NUMERIC = ["dec_lat_va", "dec_long_va", "alt_va", "drain_area_va", "contrib_drain_area_va"]
_FORMAT_ROW = r"^\d+[a-z](\t\d+[a-z])*\s*$"


def file_names(read: DataFrame) -> DataFrame:
    """(file) of everything a reader was given, empty files included, as `_metadata.file_path` writes it.

    Spark's scans leave out empty files, so the names come from the listing that the reader already holds.
    """
    names = read.sparkSession.createDataFrame([(name,) for name in read.inputFiles()], "file string")
    return names.select(F.regexp_replace("file", "^file:/+", "file:/").alias("file"))


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.rtrim("value").alias("raw"), F.col("value"))
    return lines.filter((F.length("raw") > 0) & ~F.col("value").startswith("#") & ~F.col("value").rlike(_FORMAT_ROW))


def read_rdb(spark: SparkSession, paths: str | Sequence[str], first_column: str) -> DataFrame:
    """Rows of tab-separated files as (file, fields MAP<column, text>); `first_column` marks header lines.

    Files with comments only give no rows; a file with different header lines fails the query, as its rows could
    not be told apart.
    """
    lines = _lines(spark, paths)
    is_header = F.col("value").startswith(first_column + "\t")
    one = F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(
        F.raise_error(F.concat(F.lit("different header lines in "), F.col("file"))).cast("string"))
    headers = (lines.filter(is_header).groupBy("file").agg(one.alias("_h"))
               .select("file", F.split("_h", "\t").alias("columns")))
    rows = lines.filter(~is_header).select("file", F.split("value", "\t").alias("cells"))
    joined = rows.join(headers, "file")
    width = F.least(F.size("columns"), F.size("cells"))
    fields = F.map_from_arrays(F.slice("columns", F.lit(1), width), F.slice("cells", F.lit(1), width))
    return joined.select("file", fields.alias("fields"), (F.size("cells") >= F.size("columns")).alias("whole"))


def _field(name: str):
    return F.try_element_at("fields", F.lit(name))


def read_rdb_iv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Instantaneous readings: site, local clock text, clock code and the series readings as a map."""
    fixed = ["agency_cd", "site_no", "datetime", "tz_cd"]
    rows = read_rdb(spark, paths, "agency_cd")
    series = F.map_filter("fields", lambda k, v: ~k.isin(fixed))
    values = F.transform_values(series, lambda k, v: F.nullif(F.trim(v), F.lit("")))
    return rows.select(_field("site_no").alias("site_no"), _field("datetime").alias("datetime"),
                       _field("tz_cd").alias("tz_cd"), values.alias("values"))


def read_rdb_site(spark: SparkSession, paths: str | Sequence[str], require_all: bool = True) -> DataFrame:
    """Site rows with numeric fields parsed; a file without a data row fails the query."""
    rows = read_rdb(spark, paths, "agency_cd")
    named = ["agency_cd", "site_no", "station_nm", "state_cd", "huc_cd"]
    out = rows.select("file", *[_field(c).alias(c) for c in named],
                      *[to_number(_field(c)).alias(c) for c in SITE_NUMERIC], "fields")
    if not require_all:
        return out.drop("file")
    files = file_names(spark.read.text(paths if isinstance(paths, str) else list(paths)))
    site = F.when(F.col("site_no").isNotNull(), F.col("site_no")).otherwise(
        F.raise_error(F.concat(F.lit("no site data in "), F.col("file"))).cast("string"))
    return files.join(out, "file", "left").withColumn("site_no", site).drop("file")


def read_rdb_catalog(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Series catalogue rows; rows with missing cells or without a parameter code are skipped."""
    rows = read_rdb(spark, paths, "agency_cd").filter(F.col("whole"))
    names = ["site_no", "data_type_cd", "parm_cd", "begin_date", "end_date", "count_nu"]
    return rows.select(*[_field(c).alias(c) for c in names]).filter(F.length("parm_cd") > 0)


def read_state_gauges(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Gauges of a state list, ids and coordinates as text."""
    rows = read_rdb(spark, paths, "agency_cd").filter(_field("agency_cd").startswith("USGS"))
    return rows.select(*[_field(c).alias(c) for c in ("site_no", "station_nm", "dec_lat_va", "dec_long_va", "huc_cd")])


_DAILY = T.StructType([T.StructField("value", T.StructType([T.StructField("timeSeries", T.ArrayType(T.StructType([
    T.StructField("sourceInfo", T.StructType([T.StructField("siteCode", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType())])))])),
    T.StructField("variable", T.StructType([T.StructField("noDataValue", T.DoubleType())])),
    T.StructField("values", T.ArrayType(T.StructType([T.StructField("value", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("dateTime", T.StringType())])))]))),
])))]))])


def read_daily_values(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Daily mean flow; the declared no-data value becomes null. Responses without a series give no rows."""
    docs = spark.read.schema(_DAILY).json(paths if isinstance(paths, str) else list(paths), multiLine=multi_line)
    first = docs.select(F.get("value.timeSeries", F.lit(0)).alias("s")).filter(F.col("s").isNotNull())
    rows = first.select(F.get("s.sourceInfo.siteCode", F.lit(0))["value"].alias("site_no"),
                        F.col("s.variable.noDataValue").alias("fill"),
                        F.inline(F.get("s.values", F.lit(0))["value"]))
    cfs = to_number(F.col("value"))
    return rows.select("site_no", F.substring("dateTime", 1, 10).cast("date").alias("date"),
                       F.when(F.col("fill").isNull() | (cfs != F.col("fill")), cfs).alias("cfs"))
