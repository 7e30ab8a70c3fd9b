from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from freshet.functions import clock, evaporation, geo, numbers, sql, text
from freshet.operators import clean, joins, rollups, series
from freshet.plans import catchments


def one(df):
    return df.collect()[0]


def value(spark, column):
    return one(spark.range(1).select(column.alias("x"))).x


def test_mountain_time_june(spark):
    rows = [("1", 0, "2024-06-01 00:00", "MST", "5.5"), ("1", 1, "2024-06-01 00:15", "MST", "x"), ("1", 2, "2024-06-01 01:00", "MST", "Ice")]
    raw = spark.createDataFrame(rows, "site_no string, ord int, datetime string, tz_cd string, cfs string")
    out = catchments.usgs_to_hourly_utc(raw).orderBy("ord").collect()
    assert [(r.hour_updated, r.cfs) for r in out] == [(datetime(2024, 6, 1, 6), 5.5), (datetime(2024, 6, 1, 7), None)]


@pytest.mark.parametrize("local, utc", [
    ("2023-11-05 01:30", "2023-11-05 06:30:00"),  # repeated hour: standard time
    ("2023-11-05 00:30", "2023-11-05 04:30:00"),
    ("2023-03-12 02:30", "2023-03-12 07:30:00"),  # missing hour
])
def test_clock_change(spark, local, utc):
    ts = F.to_timestamp(F.lit(local), "yyyy-MM-dd HH:mm")
    for column in (clock.local_to_utc(ts, "America/New_York"), clock.code_to_utc(ts, clock.code_number(F.lit("EDT")), F.lit("1"))):
        assert value(spark, column.cast("string")) == utc


def test_zone_of_first_row_and_unknown_code(spark):
    rows = [("1", 0, "2024-06-01 00:00", "EST"), ("1", 1, "2024-06-01 01:00", "PST")]
    df = spark.createDataFrame(rows, "site_no string, ord int, datetime string, tz_cd string")
    assert {r.datetime.hour for r in clean.local_to_utc(df).collect()} == {4, 5}
    assert clean.local_to_utc(df.withColumn("ord", F.col("datetime")), order="datetime").count() == 2
    with pytest.raises(PySparkException, match="unknown clock code at the start of 1"):
        clean.local_to_utc(df.withColumn("tz_cd", F.lit("UTC"))).collect()


@pytest.mark.parametrize("raw, number", [("1.5", 1.5), (" 2 ", 2.0), ("M", None), ("T", None), ("", None), ("1d", None), ("2F", None),
                                         ("NaN", None), ("-3e2", -300.0), ("inf", float("inf")), ("0x1p3", None)])
def test_numbers(spark, raw, number):
    assert value(spark, numbers.to_number(F.lit(raw))) == number


def test_null_fill_takes_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (-9999.0,), (-9990.0,)], "v double")
    assert [r.v for r in clean.null_fills(df, ["v"], at_most=-9990.0).collect()] == [1.0, None, None, None]


def test_rounding_ties_to_even_hour(spark):
    df = spark.createDataFrame([("2024-01-01 00:30:00",), ("2024-01-01 01:30:00",), ("2024-01-01 02:31:00",)], "t string")
    out = df.select(clock.round_to_hour(F.to_timestamp("t")).alias("h")).collect()
    assert [r.h.hour for r in out] == [0, 2, 3]


def test_weather_hour_folding(spark):
    rows = [("A", "2024-01-01 00:10", 0, "1", "M", "M"), ("A", "2024-01-01 00:50", 1, "T", "50", "OVC"), ("A", "2024-01-01 01:00", 2, "0.5", "52", "CLR"),
            ("A", "2024-01-01 01:20", 3, "M", "M", "CLR")]
    raw = spark.createDataFrame(rows, "station string, valid string, ord int, p01m string, tmpf string, skyc1 string")
    out = rollups.hourly_weather(raw, ["station"], "ord").orderBy("hour_updated").collect()
    assert [(r.hour_updated.hour, r.p01m, r.tmpf, r.skyc1) for r in out] == [(1, 1.5, 51.0, "M"), (2, 0.0, None, "CLR")]
    assert one(rollups.missing_marks(raw, ["p01m", "tmpf"])).asDict() == {"missing_p01m": 1, "missing_tmpf": 2}


def test_season_days_of_a_year(spark):
    span = spark.createDataFrame([(date(2023, 1, 1), date(2023, 12, 31))], "start date, end date")
    assert clean.season_days(span, "start", "end").count() == 288


def test_hydrologic_year_edges(spark):
    for day, year in ((date(2023, 9, 30), 2023), (date(2023, 10, 1), 2024)):
        assert value(spark, clock.hydrologic_year(F.lit(day))) == year


def test_rename_by_param(spark):
    df = spark.createDataFrame([({"9_00060": "2", "10_00060": "3", "9_00060_cd": "A", "1_00065": "7"},)], "values map<string,string>")
    assert one(clean.rename_by_param(df)).asDict() == {"cfs": "2", "height": "7", "precip_usgs": None}
    wide = spark.createDataFrame([(1, 2, 3)], ["9_00060", "9_00060_cd", "1_00045"])
    assert clean.rename_columns_by_param(wide).columns == ["cfs", "9_00060_cd", "precip_usgs"]


def test_radiation_and_evaporation(spark):
    assert abs(value(spark, evaporation.extraterrestrial_radiation(F.lit(-20.0), F.lit(246.0))) - 13.1) < 0.1
    assert value(spark, evaporation.hargreaves_pet(F.lit(5.0), F.lit(5.0), F.lit(40.0), F.lit(180.0))) == 0.0
    for lat in (-80.0, 0.0, 40.0, 66.0, 85.0):
        for doy in (1.0, 172.0, 355.0):
            weights = value(spark, evaporation.daylight_weights(F.lit(lat), F.lit(doy)))
            assert len(weights) == 24 and abs(sum(weights) - 1.0) < 1e-9
    sql.register(spark)
    here = one(spark.sql("SELECT daylight_weights(40D, 172D) AS w, band_index(2100D, array(1000D, 2000D, 3000D)) AS b"))
    assert max(abs(a - b) for a, b in zip(here.w, value(spark, evaporation.daylight_weights(F.lit(40.0), F.lit(172.0))))) < 1e-12
    assert here.b == 1


def test_uniform_evaporation_of_a_day(spark):
    rows = [("A", datetime(2024, 6, 1, h), 10.0 + h) for h in range(24)]
    df = spark.createDataFrame(rows, "site string, ts timestamp, c double")
    out = rollups.hourly_pet(df, ["site"], "ts", F.col("c"), F.lit(40.0), "uniform").collect()
    assert len({round(r.pet_mm_hr, 12) for r in out}) == 1 and len(out) == 24
    with pytest.raises(ValueError):
        rollups.hourly_pet(df, ["site"], "ts", F.col("c"), F.lit(40.0), "other")


def test_scene_id_and_names(spark):
    p = "S2B_MSIL1C_20240609T174909_N0510_R141_T13TDE_20240609T205810"
    row = one(spark.range(1).select(*[c.alias(n) for n, c in text.scene_fields(F.lit(f"tiles/13/T/DE/{p}.SAFE/")).items()]))
    assert (row.satellite, row.sensing_time, row.orbit, row.tile) == ("S2B", datetime(2024, 6, 9, 17, 49, 9), "141", "13TDE")
    assert value(spark, text.scene_fields(F.lit("S2B_MSIL2A_20240609T174909"))["tile"]) is None
    assert value(spark, text.normalise_name(F.lit("ARKANSAS RIVER NEAR NATHROP, CO."), F.lit("CO"))) == "co_arkansas_river_near_nathrop"
    assert value(spark, text.tile_prefix(F.lit("05QKB"))) == "tiles/5/Q/KB/"
    assert value(spark, text.snow_tar_path(F.lit(date(2024, 6, 1)))).endswith("/masked/2024/06_Jun/SNODAS_20240601.tar")


@pytest.mark.parametrize("start, end, months", [(date(1987, 12, 31), date(1990, 1, 1), 12), (date(2020, 3, 15), date(2022, 7, 1), 6), (date(2024, 1, 1), date(2024, 4, 1), 1)])
def test_chunks_abut(spark, start, end, months):
    out = series.calendar_chunks(spark.createDataFrame([(start, end)], "start date, end date"), months).orderBy("chunk_start").collect()
    assert out[0].chunk_start == start and out[-1].chunk_end == end
    for a, b in zip(out, out[1:]):
        assert a.chunk_end == b.chunk_start and b.chunk_start.day == 1


def test_attributes(spark):
    topo = spark.createDataFrame([("01010500", 7.5), ("06752260", 21.3)], "STAID string, SLOPE_PCT double")
    soils = spark.createDataFrame([("01010500", 0.13, 1.0), ("06752260", 0.11, 2.0)], "STAID string, AWCAVE double, SLOPE_PCT double")
    wanted = spark.createDataFrame([("06752260",)], "STAID string")
    row = one(joins.static_attributes(wanted, [topo, soils]))
    assert (row.AWCAVE, row.SLOPE_PCT) == (0.11, 2.0)
    assert joins.static_matrix([topo, soils]).columns == ["STAID", "SLOPE_PCT", "AWCAVE", "SLOPE_PCT_dup"]
    with pytest.raises(PySparkException, match="99999999"):
        joins.static_attributes(spark.createDataFrame([("99999999",)], "STAID string"), [topo]).collect()


def test_unknown_variable_fails(spark):
    df = spark.createDataFrame([(1, "x", 1.0)], "t int, variable string, value double")
    with pytest.raises(PySparkException, match="unknown variable"):
        joins.merge_series_outer(df, ["t"], ["a"]).collect()


def test_availability_needs_all_four(spark):
    rows = [("a", "1990-01-01", "1995-01-01", "2000-01-01", "1979-01-02", "2015-07-04"), ("b", "1990-01-01", None, "2000-01-01", "1979-01-02", "2015-07-04")]
    df = spark.createDataFrame(rows, "site_no string, usgs_hourly_begin string, asos_begin string, scan_begin string, nldas_begin string, sentinel_begin string")
    out = {r.site_no: (r.aligned_tabular_begin, r.aligned_multimodal_begin) for r in rollups.data_availability(df).collect()}
    assert out == {"a": ("2000-01-01", "2015-07-04"), "b": (None, None)}


def test_element_begin_prefers_duration(spark):
    rows = [("s", "SMS", "DAILY", "1990-01-01 00:00"), ("s", "SMS", "HOURLY", "1997-05-01 00:00"), ("t", "SMS", "DAILY", "1991-01-01 00:00")]
    df = spark.createDataFrame(rows, "triplet string, element_code string, duration string, begin_date string")
    assert {r.triplet: r.element_begin for r in rollups.element_begin(df).collect()} == {"s": "1997-05-01", "t": "1991-01-01"}


def test_snow_profile(spark):
    rows = [("b", 2000.0, 0.0), ("b", 2600.0, 90.0), ("b", 3000.0, 400.0), ("dry", 2000.0, 0.5)]
    fit = {r.k: (r.snow_line, r.slope) for r in rollups.snow_profile_fit(spark.createDataFrame(rows, "k string, elevation_m double, swe_mm double"), ["k"]).collect()}
    assert fit["b"][0] == 2200.0 and abs(fit["b"][1] - (400 * 90 + 800 * 400) / (400 ** 2 + 800 ** 2)) < 1e-12
    assert fit["dry"][1] == 0.0


def test_equal_area_bands(spark):
    bands = value(spark, geo.equal_area_bands(F.lit(2000.0), F.lit(0.0), 3))
    assert abs(bands[1] - 2000.0) < 1e-9 and abs(bands[2] - bands[0] - 2 * 0.9674215661) < 1e-6
    with pytest.raises(PySparkException, match="ascending"):
        value(spark, geo.band_index(F.lit(1.0), F.array(F.lit(2.0), F.lit(1.0))))
