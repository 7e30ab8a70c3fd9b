"""Work that has to grow with its input: what is sent to all tasks, compared, held and sent on."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import joins, nearby, spatial, vectors
from freshet.plans import snow
from freshet.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def on_disk(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_grid_of_many_days_is_not_sent_to_all_tasks(spark, tmp_path):
    cells = on_disk(spark.range(60).select(F.col("id").alias("cell_id"), F.col("id").cast("double").alias("swe_mm")), tmp_path / "cells")
    mask = on_disk(spark.createDataFrame([("a", 5), ("a", 6), ("a", 6), ("b", 7)], "site_no string, cell_id bigint"), tmp_path / "mask")
    dated = cells.withColumn("date", F.explode(F.sequence(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 9)))))
    for means in (spatial.basin_mean_mask(dated, mask), snow.basin_swe_series(dated, mask)):
        assert "BroadcastHashJoin" not in plan(means)
    got = {(r.site_no, r.date.day): (r.mean_swe_mm, r.cells) for r in spatial.basin_mean_mask(dated, mask).collect()}
    assert got == {(s, d): v for d in range(1, 10) for s, v in (("a", (17 / 3, 3)), ("b", (7.0, 1)))}


def test_pairs_of_one_key_are_the_work_of_many_tasks(spark):
    left = spark.createDataFrame([("hot", i) for i in range(7)] + [("cold", 9), ("alone", 10), (None, 11)], "k string, a int")
    right = spark.createDataFrame([("hot", i // 2) for i in range(60)] + [("cold", 1), (None, 2), ("other", 3)], "k string, b int")
    out = joins.dealt_join(left, right, ["k"], part_rows=5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert out.columns == ["k", "a", "b"] and "_part" in plan(out)


def test_rows_of_one_key_are_dealt_on_both_sides(spark):
    left = spark.createDataFrame([("hot", i // 3) for i in range(50)] + [("cold", 9), (None, 11)], "k string, a int")
    right = spark.createDataFrame([("hot", i // 2) for i in range(20)] + [("cold", 1), (None, 2)], "k string, b int")
    out = joins.dealt_join(left, right, ["k"], part_rows=6, left_rows=7)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert out.columns == ["k", "a", "b"]


def test_boxes_of_a_point_come_one_after_the_other(spark):
    stations = spark.range(90).select(F.concat(F.lit("s"), "id").alias("station_id"), (F.col("id") / 900).alias("lat"), (F.col("id") / 800).alias("lon"), F.col("id").cast("double").alias("elevation"))
    readings = stations.select("station_id", F.col("elevation").alias("WTEQ"), F.lit(date(2024, 6, 5)).alias("date"))
    boxes = spark.range(120).select(F.concat(F.lit("b"), "id").alias("site_no"), F.lit(-1.0).alias("min_lon"), F.lit(-1.0).alias("min_lat"), F.lit(1.0).alias("max_lon"), F.lit(1.0).alias("max_lat"))
    rows = snow.sample_basin_snotel(boxes, stations, readings, "2024-06-05", digits=2).collect()
    assert len({(r.site_no, r.station_id) for r in rows}) == len(rows) == 90 * 120
    assert sum(a.station_id != b.station_id for a, b in zip(rows, rows[1:])) < 2 * 90
    assert {(r.station_id, r.elevation_m, r.swe_mm) for r in rows} == {(f"s{i}", round(i * 0.3048, 2), round(i * 25.4, 2)) for i in range(90)}


def test_distances_of_a_state_are_dealt_out(spark):
    from freshet.catalog import QUERIES

    for name in ("haversine_km", "bbox_join", "sample_basin_snotel"):
        assert "_part" in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_readings_meet_stations_before_boxes(spark):
    stations = spark.createDataFrame([("s1", 0.1, 0.1, 100.0), ("s2", 0.2, 0.2, 200.0), ("s2", 0.2, 0.2, 200.0), ("s3", 5.0, 5.0, 1.0), (None, 0.1, 0.1, 1.0)],
                                     "station_id string, lat double, lon double, elevation double")
    readings = spark.createDataFrame([("s1", 1.0), ("s1", 2.0), ("s2", 3.0), ("s3", 4.0), (None, 5.0), ("s2", None)], "station_id string, WTEQ double").withColumn("date", F.lit(date(2024, 6, 5)))
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 0.15, 0.15, 0.2, 0.2)], "site_no string, min_lon double, min_lat double, max_lon double, max_lat double")
    out = snow.sample_basin_snotel(boxes, stations, readings, "2024-06-05")
    got = sorted((r.site_no, r.station_id, round(r.swe_mm / 25.4, 6)) for r in out.collect())
    assert got == [("a", "s1", 1.0), ("a", "s1", 2.0), ("a", "s2", 3.0), ("a", "s2", 3.0), ("b", "s2", 3.0), ("b", "s2", 3.0)]
    tree = plan(out)
    assert tree.index("_part") < tree.index("WTEQ IS NOT NULL" if "WTEQ IS NOT NULL" in tree else "isnotnull(WTEQ")


def test_dense_places_give_few_candidates(spark):
    rng = np.random.default_rng(5)
    at = lambda n: pd.DataFrame({"lat": 40 + rng.random(n) / 3, "lon": -105 + rng.random(n) / 3})
    g, s = at(300).assign(site_no=np.arange(300).astype(str)), at(1500).assign(station_id=np.arange(1500).astype(str), ord=np.arange(1500))
    left, right = spark.createDataFrame(g), spark.createDataFrame(s)
    met = nearby._ranked_candidates(left, right, 3, [], nearby.LEVELS, "site_no")
    assert met.count() < 300 * 1500 / 2
    ranked = {(r.site_no, r["rank"]): r.distance_km for r in nearby.k_nearest_stations(left, right, 3).collect()}
    a, b = np.radians(g[["lat", "lon"]].to_numpy()), np.radians(s[["lat", "lon"]].to_numpy())
    h = np.sin((b[None, :, 0] - a[:, None, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((b[None, :, 1] - a[:, None, 1]) / 2) ** 2
    want = np.sort(2 * 6371.0 * np.arcsin(np.sqrt(h)), 1)[:, :3]
    assert all(abs(ranked[str(i), k + 1] - want[i, k]) < 2e-6 for i in range(300) for k in range(3)) and len(ranked) == 900


def test_block_gives_only_rows_within_reach(spark):
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(40, 8))
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    unit[30:] = unit[0]  # copies
    rows = pd.DataFrame({"id": [f"v{i}" for i in range(40)], "unit": list(unit)})
    own, pair = vectors._block_best(5, "own"), vectors._block_best(5, "pair")
    bounded = own(rows.iloc[:20])
    right = rows.rename(columns={"id": "near_id", "unit": "near_unit"})
    found = pair(None, bounded, right.iloc[20:])
    assert len(found) < 20 * 5
    both = pd.concat([found, pair(None, bounded, right.iloc[:20])]).sort_values(["id", "sim", "neighbour"], ascending=[True, False, True]).groupby("id").head(5)
    for i in range(20):
        sims = sorted((-round(float(unit[i] @ unit[j]), 9), f"v{j}") for j in range(40) if j != i)[:5]
        assert both[both["id"] == f"v{i}"]["neighbour"].tolist() == [v for _, v in sims]


def test_a_row_is_sent_once_for_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(400, 6))
    points[380:] = points[5]  # copies
    df = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(points)], "site_no string, embedding array<double>")
    sent, best = spark.sparkContext.accumulator(0), vectors._block_best

    def counted(k, name):
        work = best(k, name)

        def pairs(key, left, right):
            sent.add(len(left) + len(right))
            return work(key, left, right)

        return work if name == "own" else pairs

    monkeypatch.setattr(vectors, "_block_best", counted)
    got = {(r.site_no, r["rank"]): r.neighbour for r in vectors.cosine_neighbours(df, 3, block_rows=10).collect()}
    assert 0 < sent.value < 400 * 2 * 8
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    for i in range(400):
        nearest = sorted((-round(float(unit[i] @ unit[j]), 9), f"v{j:03d}") for j in range(400) if j != i)[:3]
        assert [got[f"v{i:03d}", n] for n in (1, 2, 3)] == [v for _, v in nearest]


def test_rows_with_many_near_columns_are_reckoned_as_a_whole():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 5)) + 3 * (np.arange(300) % 2)[:, None]
    a = a / np.linalg.norm(a, axis=1)[:, None]
    b, ids = np.concatenate([a[:200], np.repeat(a[7:8], 150, 0)]), np.arange(1000, 1350)
    floor = np.where(np.arange(300) % 3, -2.0, 0.99)
    row, column, sim = vectors._near(a, a.astype(np.float32), np.arange(300) + 1000, b, ids, floor, 4)
    exact = np.round(a @ b.T, 9)
    for i in range(300):
        here = sorted((-s, ids[c]) for s, c in zip(sim[row == i], column[row == i]))[:4]
        want = sorted((-exact[i, c], ids[c]) for c in range(350) if ids[c] != 1000 + i and exact[i, c] >= floor[i])[:4]
        assert [n for _, n in here][:len(want)] == [n for _, n in want]


def test_waiting_rows_are_reduced_as_they_come(monkeypatch):
    monkeypatch.setattr(jobs, "GATHERED_ROWS", 100)
    sizes = []

    def reduce(rows):
        sizes.append(len(rows))
        return rows.drop_duplicates("s")

    (rows,) = jobs.gathered((pd.DataFrame({"s": np.arange(50) % 40}) for _ in range(200)), reduce)
    assert sorted(rows["s"]) == list(range(40)) and max(sizes) <= 190
    assert jobs.gathered(iter([pd.DataFrame({"s": []})]), reduce) == []


def test_images_of_one_second_wait_as_one(spark, tmp_path):
    from tests.test_streams_in_order import KIND, run_files

    begin = pd.Timestamp("2024-05-01")
    rows = [("c", (begin + pd.Timedelta(seconds=i // 50, milliseconds=900 - i % 50)).to_pydatetime(), f"k{i:04d}") for i in range(400)]
    closing = [("closing", (begin + pd.Timedelta(days=9)).to_pydatetime(), "")]
    got, late = run_files(spark, tmp_path, "seconds", [rows[200:], rows[:200], closing], lambda s: jobs.stream_thin_by_gap(s, 0.05, lateness="2 days"), KIND)
    assert {r["key"] for r in got.collect() if r["key"]} == {"k0049", "k0199", "k0349"} and late == 0


def test_waiting_days_are_worked_through_one_by_one(spark, tmp_path):
    from tests.test_streams_in_order import KIND, run_files

    begin = pd.Timestamp("2024-05-01 18:00")
    rows = [("c", (begin + pd.Timedelta(hours=i)).to_pydatetime(), f"k{i:04d}") for i in range(24 * 6)]
    closing = [("closing", (begin + pd.Timedelta(days=90)).to_pydatetime(), "")]

    def fold(camera, memory, ready, now):
        seen = int(memory or 0) + len(ready)
        made = pd.DataFrame({"camera_id": [camera], "n": [len(ready)], "seen": [seen],
                             "first": [pd.to_datetime(ready["datetime"]).min()], "until": pd.to_datetime([now], unit="ms")})
        return str(seen), made if len(ready) and camera == "c" else made.iloc[:0], None

    got, late = run_files(spark, tmp_path, "days", [rows[1::2], rows[::2], closing], lambda s: jobs.replay_in_order(
        s, "camera_id", "datetime", "30 days", fold, "camera_id string, n int, seen int, first timestamp, until timestamp", block_ms=jobs.DAY_MS), KIND)
    calls = sorted(got.collect(), key=lambda r: r["first"])
    assert [r.n for r in calls] == [6, 24, 24, 24, 24, 24, 18] and [r.seen for r in calls] == [6, 30, 54, 78, 102, 126, 144] and late == 0
    assert all(a["first"] < a.until <= b["first"] for a, b in zip(calls, calls[1:]))


def test_waiting_rows_take_little_room():
    at = pd.Timestamp("2024-05-01") + pd.to_timedelta(np.arange(40_000) * 7, unit="s")
    rows = pd.DataFrame({"camera_id": "CO_Cam_1", "datetime": at, "key": [f"overlay/CO_Cam_1/CO_Cam_1___{t:%Y-%m-%dT%H-%M-%S}Z.jpg" for t in at]})
    blocks = {}
    for i in range(100):
        jobs.wait(blocks, rows.iloc[i::100], "datetime", 0, jobs.DAY_MS, lambda r: r.sort_values("datetime"))
    kept = pd.concat([jobs.unpacked(b[0], lambda r: r) for _, b in sorted(blocks.items())]).sort_values("datetime")
    assert kept["key"].tolist() == rows["key"].tolist() and len(blocks) == 4
    assert max(len(b[0]) for b in blocks.values()) <= jobs.PIECES and sum(len(p) for b in blocks.values() for p in b[0]) < 25 * len(rows)


def test_an_hours_image_list_is_written_once(spark, tmp_path):
    hour = F.timestamp_seconds(F.col("h") * 3600).alias("hour_updated")
    rows = spark.range(24 * 20).select(F.when(F.col("id") != 5, "a").alias("site_no"), (F.col("id") % 25).alias("h"), F.col("id").alias("ord"))
    joined = on_disk(rows.select("site_no", hour, "ord").repartition(4, "ord"), tmp_path / "joined")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.sha2(F.concat_ws("-", F.col("id"), i), 256)), ",")
    lists = spark.range(24).select(F.lit("a").alias("site_no"), F.col("id").alias("h"), text.alias("paths")).select("site_no", hour, "paths")
    images = on_disk(lists.unionByName(lists.limit(1).withColumn("paths", F.lit("again"))), tmp_path / "images")
    out = on_disk(joins.images_left(joined, images, ["site_no"]), tmp_path / "out")
    plain = joined.join(images, ["site_no", "hour_updated"], "left")
    assert out.columns == plain.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, plain.collect()))

    def size(name):
        return sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))

    assert size("out") < 1.2 * size("images") + 100_000
    assert out.filter("paths IS NULL").count() > 0 and size("images") > 1_500_000
    as_is = joins.images_left(joined, images, ["site_no"], list_bytes=None)
    assert "REPARTITION" not in plan(as_is) and as_is.count() == out.count()
