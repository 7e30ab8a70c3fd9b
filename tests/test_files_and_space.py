"""Readers over real files, basin geometry and writers."""

import gzip
import io
import json
import struct
import tarfile
import zlib
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from freshet import sinks
from freshet.operators import clean, joins, rollups, spatial
from freshet.sources import gauges, grids, weather

SQUARE = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
HOLE = [[0.2, 0.2], [0.5, 0.2], [0.5, 0.5], [0.2, 0.5], [0.2, 0.2]]
FAR = [[2.0, 2.0], [3.0, 2.0], [3.0, 3.0], [2.0, 3.0], [2.0, 2.0]]


def outlines(spark, *polygons):
    return spark.createDataFrame([(str(i), p) for i, p in enumerate(polygons)], f"site_no string, polygons {spatial.POLYGON_TYPE}")


def grid(spark, n=30, step=0.1, low=0.05):
    cells = [(i * n + j, i, j, low + i * step, low + j * step) for i in range(n) for j in range(n)]
    return spark.createDataFrame(cells, "cell_id bigint, row int, col int, lat double, lon double")


def test_masks(spark):
    cells = grid(spark)
    mask = spatial.polygon_join(cells, outlines(spark, [[SQUARE]], [[SQUARE, HOLE]], [[SQUARE], [FAR]], [[[[9.0, 9.0], [9.1, 9.0], [9.1, 9.1], [9.0, 9.0]]]]))
    counts = {r.site_no: r.n for r in mask.groupBy("site_no").agg(F.count("*").alias("n")).collect()}
    assert counts == {"0": 100, "1": 91, "2": 200}
    empty = spatial.empty_basins(spark.createDataFrame([("0",), ("3",)], "site_no string"), mask)
    assert [r.site_no for r in empty.collect()] == ["3"]


def test_mask_equals_sequential_even_odd(spark):
    rng = np.random.default_rng(2)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 60))
    star = [[float(1.5 + r * np.cos(a)), float(1.5 + r * np.sin(a))] for a, r in zip(angle, rng.uniform(0.3, 1.4, 60))]
    star.append(star[0])
    mask = spatial.polygon_join(grid(spark), outlines(spark, [[star]]), size=0.17).toPandas()
    want = set()
    for i in range(30):
        for j in range(30):
            y, x, odd = 0.05 + i * 0.1, 0.05 + j * 0.1, False
            for (x1, y1), (x2, y2) in zip(star, star[1:]):
                if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                    odd = not odd
            if odd:
                want.add(i * 30 + j)
    assert set(mask.cell_id) == want


def test_box_of_two_parts(spark):
    row = spatial.basin_bbox(outlines(spark, [[SQUARE], [FAR]]), buffer_degrees=0.0).collect()[0]
    assert (row.min_lon, row.min_lat, row.max_lon, row.max_lat) == (0.0, 0.0, 3.0, 3.0)


def test_basin_means(spark):
    cells = grid(spark, 4).withColumn("swe_mm", F.when(F.col("cell_id") == 5, 100.0).when(F.col("cell_id") == 6, 200.0))
    boxes = spark.createDataFrame([("b", 0.1, 0.1, 0.3, 0.2)], "site_no string, min_lon double, min_lat double, max_lon double, max_lat double")
    assert spatial.basin_mean_bbox(cells, boxes).collect()[0].mean_swe_mm == 150.0
    mask = spark.createDataFrame([("a", 5), ("a", 6), ("dry", 0)], "site_no string, cell_id bigint")
    means = {r.site_no: r.mean_swe_mm for r in spatial.basin_mean(cells, mask).collect()}
    assert means == {"a": 150.0, "dry": None}
    with pytest.raises(PySparkException, match="no valid cells"):
        spatial.basin_mean_strict(cells, mask, spark.createDataFrame([("dry",)], "site_no string")).collect()
    dated = cells.withColumn("date", F.lit(date(2024, 1, 1)))
    assert spatial.basin_mean_mask(dated, mask, shape=(4, 4)).count() == 2
    with pytest.raises(PySparkException, match="grid shape changed"):
        spatial.basin_mean_mask(dated, mask, shape=(5, 4)).collect()


def test_terrain_and_bands(spark):
    dem = grid(spark, 5, 1.0, 0.0).withColumn("elevation_m", F.col("row") * 500.0 + 1000)
    points = spark.createDataFrame([(0, 0.4, 0.0), (1, 0.5, 0.0), (2, 40.0, -9.0)], "cell_id bigint, lat double, lon double")
    got = {r.cell_id: r.elevation_m for r in spatial.dem_sample_nn(points, dem, 1.0).collect()}
    assert got == {0: 1000.0, 1: 1000.0, 2: 3000.0}  # ties take the first row, far points the edge
    cells = spark.createDataFrame([(0, 1000.0, 0.0), (1, 2000.0, 10.0), (2, 3000.0, 95.0), (3, 3000.0, None)], "cell_id bigint, elevation_m double, swe_mm double")
    mask = spark.createDataFrame([("a", i) for i in range(4)], "site_no string, cell_id bigint")
    bands = spark.createDataFrame([("a", [1000.0, 2000.0, 3000.0, 9000.0])], "site_no string, bands array<double>")
    out = spatial.band_means(cells, mask, bands).orderBy("band").collect()
    assert [(r.cells, r.mean_swe_mm) for r in out] == [(1, 0.0), (1, 10.0), (1, 95.0), (0, None)]
    assert out[0].basin_mean_swe_mm == 35.0


def test_outline_forms(spark, tmp_path):
    shape = {"type": "Polygon", "coordinates": [SQUARE]}
    forms = {"a": shape, "b": {"type": "Feature", "geometry": shape, "properties": {}}, "c": {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [FAR]]}, "properties": {"site_no": "c9"}}]}}
    for name, doc in forms.items():
        (tmp_path / f"{name}_basin.geojson").write_text(json.dumps(doc, indent=1))
    out = {r.site_no: len(r.polygons) for r in grids.read_basins(spark, str(tmp_path)).collect()}
    assert out == {"a": 1, "b": 1, "c9": 2}
    for bad, message in (({"type": "Point", "coordinates": [0, 0]}, "unsupported geometry"), ({"type": "FeatureCollection", "features": []}, "exactly one feature")):
        with pytest.raises(PySparkException, match=message):
            spark.createDataFrame([(json.dumps(bad),)], "v string").select(spatial.geometry_polygons(F.col("v"))).collect()


def archive(values, day, gz=True):
    header = "\n".join(["Number of columns: 3", "Number of rows: 2", "Benchmark x-axis coordinate: -105.5", "Benchmark y-axis coordinate: 41.0", "X-axis resolution: 0.5",
                        "Y-axis resolution: 0.25", "Data slope: 2.0", "Data intercept: 1.0", "Start year: 2024", "Start month: 6", f"Start day: {day}", "Note: a: b"])
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, raw in (("us_ssmv11036.dat", b"\0\1"), ("us_ssmv11034tS.dat", np.array(values, ">i2").tobytes()), ("us_ssmv11034tS.txt", header.encode())):
            raw = gzip.compress(raw) if gz else raw
            info = tarfile.TarInfo(name + (".gz" if gz else ""))
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def test_snow_archives(spark, tmp_path):
    (tmp_path / "one.tar").write_bytes(archive([0, -9999, 3, 4, 5, 6], 1))
    (tmp_path / "two.tar").write_bytes(archive([9, 9, 9, 9, 9, 9], 2, gz=False))
    cells = grids.snow_tars_to_cells(spark, str(tmp_path))
    first = cells.filter("date = '2024-06-01'").orderBy("cell_id").collect()
    assert [r.swe_mm for r in first] == [1.0, None, 7.0, 9.0, 11.0, 13.0]
    assert (first[5].lat, first[5].lon, first[5].row, first[5].col) == (40.75, -104.5, 1, 2)
    assert grids.snow_tars_to_cells(spark, str(tmp_path), box=(-105.1, 40.9, -104.9, 41.1)).count() == 2
    with pytest.raises(PySparkException, match="grid shape"):
        grids.check_grid(cells, (3, 3)).collect()
    with pytest.raises(PySparkException, match="no data and header"):
        grids.snow_tars_to_cells(spark, str(tmp_path / "one.tar"), product="9999").collect()


def test_days_choose_the_archives(spark, tmp_path):
    """No other day's file is opened: the others are broken."""
    for day in range(1, 6):
        good = day in (2, 3)
        (tmp_path / f"SNODAS_2024060{day}.tar").write_bytes(archive([day] * 6, day) if good else b"broken")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    some = grids.snow_tars_to_cells(spark, str(tmp_path), start="2024-06-02", end="2024-06-03")
    assert some.rdd.getNumPartitions() == 2 and {str(r.date) for r in some.filter("swe_mm > 5").collect()} == {"2024-06-03"}
    assert some.count() == 12 and grids.snow_tars_to_cells(spark, str(tmp_path), start="2030-01-01").count() == 0
    with pytest.raises(PySparkException):
        grids.snow_tars_to_cells(spark, str(tmp_path)).collect()


def test_day_maps_of_a_period(spark, tmp_path):
    for day in range(1, 8):
        (tmp_path / f"2024010{day}.json").write_bytes(b'{"a": %d}' % day if day in (3, 4) else b"\xff broken")
    out = grids.read_day_maps(spark, str(tmp_path), start="2024-01-03", end="2024-01-04").collect()
    assert sorted((str(r.datetime), r.snodas_swe_mm) for r in out) == [("2024-01-03", 3.0), ("2024-01-04", 4.0)]


def test_files_are_written_whole(spark, tmp_path):
    from freshet.sinks import write_files

    rows = spark.createDataFrame([(f"a/{i}.bin", bytes([i]) * i) for i in range(20)], "name string, content binary").repartition(4)
    for _ in range(2):  # a repeated task leaves one copy
        write_files(rows, f"file:{tmp_path}")
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {f"a/{i}.bin": bytes([i]) * i for i in range(20)}


def png(pixels):
    height, width, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[r].tobytes() for r in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_terrain_tiles(spark, tmp_path):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (8, 8, 3)).astype(np.uint8)
    folder = tmp_path / "3" / "2"
    folder.mkdir(parents=True)
    (folder / "1.png").write_bytes(png(pixels))
    out = grids.dem_tiles_to_pixels(spark, str(tmp_path), 3, (-180, -90, 180, 90), tile_size=8).toPandas().set_index(["row", "col"])
    p = pixels.astype(float)
    height = p[:, :, 0] * 256 + p[:, :, 1] + p[:, :, 2] / 256 - 32768
    for r in range(8):
        for c in range(8):
            assert out.loc[(8 + r, 16 + c)].elevation_m == height[r, c]
    assert grids.dem_tiles_to_pixels(spark, str(tmp_path), 3, (-90, -90, -80, 90), tile_size=8).count() == 16


def test_day_maps(spark, tmp_path):
    for name, text in (("20240102.json", '{"a": 2.0, "b": NaN}'), ("20240101.json", '{"a": 1.5}'), ("20240103.json", '{"missing": true}'), ("notes.txt", "no")):
        (tmp_path / name).write_text(text)
    out = grids.read_day_maps(spark, str(tmp_path)).orderBy("datetime", "site_no").collect()
    assert [(str(r.datetime), r.site_no, r.snodas_swe_mm) for r in out] == [("2024-01-01", "a", 1.5), ("2024-01-02", "a", 2.0), ("2024-01-02", "b", None)]


RDB = "# note\n#    TS_ID Parameter\nagency_cd\tsite_no\tdatetime\ttz_cd\t9_00060\t9_00060_cd\n5s\t15s\t20d\t6s\t14n\t10s\nUSGS\t01010000\t2020-01-01 00:00\tEST\t\tA\nUSGS\t01010000\t2020-01-01 00:15\tEST\t3.5\tA\n"


def test_gauge_files(spark, tmp_path):
    (tmp_path / "iv.txt").write_text(RDB)
    (tmp_path / "none.txt").write_text("#  No sites found\n#\n")
    read = clean.rename_by_param(gauges.read_rdb_iv(spark, str(tmp_path))).orderBy("datetime").collect()
    assert [(r.site_no, r.datetime, r.cfs) for r in read] == [("01010000", "2020-01-01 00:00", None), ("01010000", "2020-01-01 00:15", "3.5")]
    assert gauges.read_rdb_iv(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(PySparkException, match="no site data"):
        gauges.read_rdb_site(spark, str(tmp_path / "none.txt")).collect()


def test_daily_values(spark, tmp_path):
    doc = {"value": {"timeSeries": [{"sourceInfo": {"siteCode": [{"value": "06"}]}, "variable": {"noDataValue": -999999.0}, "values": [{"value": [
        {"value": "5.1", "dateTime": "2020-01-01T00:00:00.000"}, {"value": "-999999", "dateTime": "2020-01-02T00:00:00.000"}]}]}]}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text('{"value": {"timeSeries": []}}')
    assert [r.cfs for r in gauges.read_daily_values(spark, str(tmp_path)).orderBy("date").collect()] == [5.1, None]


def test_forcing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("prod,x\nlat,1\n\nTimestamp (UTC),Data\n2024-01-01T00:00:00Z,1.5\n2024-01-01T01:00:00Z,-9999\n")
    out = weather.read_forcing_csv(spark, str(tmp_path / "a.csv")).orderBy("datetime").collect()
    assert [r.value for r in out] == [1.5, None]
    assert rollups.null_profile(weather.read_forcing_csv(spark, str(tmp_path / "a.csv")), ["value"]).collect()[0].missing == 1
    (tmp_path / "b.csv").write_text("<html>denied</html>\n")
    with pytest.raises(PySparkException, match="no timestamp header"):
        weather.read_forcing_csv(spark, str(tmp_path / "b.csv")).collect()


def test_element_files(spark, tmp_path):
    doc = [{"stationTriplet": "1:CO:SCAN", "data": [{"stationElement": {"elementCode": "SMS", "heightDepth": -2}, "values": [{"date": "2024-01-01 00:00", "value": 10.0}]},
                                                    {"stationElement": {"elementCode": "WTEQ"}, "values": [{"date": "2024-01-01 00:00", "value": 3.0}]}]}]
    (tmp_path / "e.json").write_text(json.dumps(doc, indent=1))
    long = weather.read_awdb_elements(spark, str(tmp_path))
    wide = joins.merge_series_outer(long, ["triplet", "date"], ["SMS_-2in", "SMS_-4in", "WTEQ"], name="column_name").collect()
    assert [tuple(r) for r in wide] == [("1:CO:SCAN", "2024-01-01 00:00", 10.0, None, 3.0)]


def test_registry_is_empty_at_first(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert sinks.read_registry(spark, path).count() == 0
    rows = [("1", "failed", 0, "x", 1), ("1", "completed", 9, None, 2), ("2", "failed", 0, "y", 1)]
    df = spark.createDataFrame(rows, "site_no string, status string, rows bigint, error string, t int").select("*", F.timestamp_seconds("t").alias("finished_at")).drop("t")
    sinks.write_registry(df, path)
    counts = {r.status: r.n for r in rollups.status_counts(sinks.read_registry(spark, path)).collect()}
    assert counts == {"completed": 1, "failed": 1}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=20, unique=True))
def test_box_join_is_exact(spark, points):
    placed = spark.createDataFrame([(i, x / 20, y / 20) for i, (x, y) in enumerate(points)], "id int, lon double, lat double")
    boxes = spark.createDataFrame([("a", 0.5, 0.5, 2.0, 1.0), ("b", 1.0, 1.0, 1.0, 1.0)], "site_no string, min_lon double, min_lat double, max_lon double, max_lat double")
    got = {(r.site_no, r.id) for r in spatial.bbox_join(placed, boxes).select("site_no", "id").collect()}
    want = {(s, i) for s, a, b, c, e in (("a", 0.5, 0.5, 2.0, 1.0), ("b", 1.0, 1.0, 1.0, 1.0)) for i, (x, y) in enumerate(points) if a <= x / 20 <= c and b <= y / 20 <= e}
    assert got == want


def test_many_holes_patterns_and_limits(spark):
    from pyspark.sql import functions as F

    from freshet.operators.joins import camera_patterns, static_matrix
    from freshet.operators.scenes import thin_by_gap

    gauges = spark.createDataFrame([("co", "a b", "1"), ("co", "", "2"), ("co", None, "3"), (None, "x", "4")],
                                   "state string, name string, site string")
    made = gauges.select("site", camera_patterns(F.col("state"), F.col("name"), F.col("site")).alias("p")).collect()
    assert [r.site for r in made if r.p] == ["1"] and "co_a_b" in made[0].p

    table = spark.createDataFrame([("1", 2.0)], "STAID string, x double")
    assert static_matrix([table] * 4).columns == ["STAID", "x", "x_dup", "x_dup2", "x_dup3"]

    images = spark.sql("""SELECT 'c' AS camera_id, concat('k', id) AS key, timestamp_seconds(id * 60) AS datetime
                          FROM range(10)""")
    since = spark.sql("SELECT 'c' AS camera_id, timestamp_seconds(300) AS since")
    kept = thin_by_gap(images, 0, max_images=3, state=since).orderBy("datetime").collect()
    assert [r.key for r in kept] == ["k5", "k6", "k7"]


def test_empty_files_fail(spark, tmp_path):
    folder = tmp_path / "a + b%20c"
    folder.mkdir()
    site = folder / "one.txt"
    site.write_text("# note\nagency_cd\tsite_no\n5s\t15s\nUSGS\t01\n")
    assert [r.site_no for r in gauges.read_rdb_site(spark, str(folder)).collect()] == ["01"]
    (folder / "none.txt").write_text("")
    with pytest.raises(PySparkException, match="no site data"):
        gauges.read_rdb_site(spark, str(folder)).collect()
    forcing = tmp_path / "forcing +"
    forcing.mkdir()
    (forcing / "a.csv").write_text("note\nTimestamp (UTC),Data\n2024-01-01 00:00,1\n")
    assert [r.value for r in weather.read_forcing_csv(spark, str(forcing)).collect()] == [1.0]
    (forcing / "b.csv").write_text("")
    with pytest.raises(PySparkException, match="no timestamp header"):
        weather.read_forcing_csv(spark, str(forcing)).collect()


def test_one_header_per_file(spark, tmp_path):
    block = "agency_cd\tsite_no\tdatetime\ttz_cd\t1_{0}\nUSGS\t01\t2024-01-01 00:00\tEST\t3\n"
    (tmp_path / "same.txt").write_text(block.format("00060") * 2)
    assert gauges.read_rdb_iv(spark, str(tmp_path / "same.txt")).count() == 2
    (tmp_path / "two.txt").write_text(block.format("00060") + block.format("00065"))
    with pytest.raises(PySparkException, match="different header lines"):
        gauges.read_rdb_iv(spark, str(tmp_path / "two.txt")).collect()


@pytest.mark.parametrize("step", [0.1, 2.0, 50.0])
def test_terrain_wider_than_the_step(spark, step):
    axis = [0.0, 2.0, 9.0]
    dem = spark.createDataFrame([(i, j, axis[i], axis[j], float(10 * i + j)) for i in range(3) for j in range(3)],
                                "row int, col int, lat double, lon double, elevation_m double")
    wanted = [-5.0, 0.9, 1.1, 5.4, 5.6, 20.0]
    cells = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate((a, b) for a in wanted for b in wanted)], "cell_id int, lat double, lon double")
    nearest = lambda v: min(range(3), key=lambda k: (abs(axis[k] - v), k))
    for r in spatial.dem_sample_nn(cells, dem, step).collect():
        assert r.elevation_m == 10 * nearest(r.lat) + nearest(r.lon)


def test_reports_of_one_minute_and_equal_finish_times(spark):
    rows = [("K", "2024-01-01 00:10", "1", "b"), ("K", "2024-01-01 00:10", "1", "a"), ("K", "2024-01-01 00:20", "0", "0")]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "station string, valid string, mslp string, skyc1 string").repartition(3)
        assert [(r.valid, r.skyc1) for r in rollups.hourly_weather(df).collect()] == [("2024-01-01 00:10", "a")]
        states = spark.createDataFrame([(s[0], s[3]) for s in some], "site_no string, status string").withColumn("finished_at", F.lit(None).cast("timestamp"))
        assert [r.status for r in sinks.latest_per_key(states).collect()] == ["b"]


def test_sql_functions_agree_with_columns(spark):
    from freshet.functions import geo, sql
    sql.register(spark)
    one = spark.range(1)
    assert spark.sql("SELECT equal_area_bands(2000D, 0.5D) AS b").first().b == one.select(geo.equal_area_bands(F.lit(2000.0), F.lit(0.5)).alias("b")).first().b
    assert spark.sql("SELECT band_index(1600D, array(1000D, 2000D, 3000D)) AS b").first().b == 1
    assert spark.sql("SELECT band_index(1600D, array(1000D)) AS b").first().b == 0
    with pytest.raises(PySparkException, match="ascending"):
        spark.sql("SELECT band_index(x, array(3000D, x)) AS b FROM VALUES (1600D) t(x)").collect()
    assert abs(sum(spark.sql("SELECT daylight_weights(40D, 172D) AS w").first().w) - 1) < 1e-9
