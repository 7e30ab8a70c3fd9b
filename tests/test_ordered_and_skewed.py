"""Ordered operators against plain sequential versions, with one key that holds most rows."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import blocks, clean, joins, nearby, panels, records, scenes, series, vectors


@pytest.fixture(scope="module")
def readings():
    rng = np.random.default_rng(7)
    n = 4000
    keys = np.where(rng.random(n) < 0.7, "hot", np.char.add("k", rng.integers(0, 5, n).astype(str)))
    minutes = rng.integers(0, 60 * 24 * 40, n)
    values = np.where(rng.random(n) < 0.8, np.nan, rng.integers(0, 100, n).astype(float))
    return pd.DataFrame({"k": keys, "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, unit="m"), "id": np.arange(n), "v": values})


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))) if "v" in pdf else df




def test_positions_and_fills(spark, readings):
    df = to_spark(spark, readings)
    order = [F.col("t"), F.col("id")]
    day = F.to_date("t")
    placed = blocks.with_position(df, ["k"], order, day).toPandas().set_index("id").position
    nearest = series.fill_nearest(df, ["k"], order, day, "v", "f").toPandas().set_index("id").f
    middle = series.fill_mean_of_neighbours(df, ["k"], order, day, "v", "f").toPandas().set_index("id").f
    for _, group in readings.sort_values(["t", "id"]).groupby("k"):
        assert placed[group.id].tolist() == list(range(1, len(group) + 1))
        mean = (group.v.ffill() + group.v.bfill()) / 2
        np.testing.assert_allclose(middle[group.id].to_numpy(float), mean.to_numpy())
        known = np.flatnonzero(group.v.notna())
        want = [group.v.iloc[known[np.argmin(np.abs(known - i))]] for i in range(len(group))]  # argmin: earlier wins
        assert nearest[group.id].tolist() == want


def test_split_bands_and_cutoff(spark, readings):
    df = to_spark(spark, readings)
    out = clean.calendar_split(df, ["k"], [F.col("t"), F.col("id")], F.to_date("t"), {"train": (10, 50), "test": (50, 60)}, ts="t", cutoff="2024-01-20")
    hot = out.filter("k = 'hot'").toPandas()
    assert (hot.split == "train").sum() == 40 and (hot.split == "test").sum() == 10 and hot.t.max() < pd.Timestamp("2024-01-20")


def test_trim_ends(spark):
    weather = spark.range(30).select(F.lit("a").alias("site_no"), F.timestamp_seconds(F.col("id") * 3600).alias("hour_updated"), F.col("id").alias("p01m"))
    flow = spark.range(10, 40).select(F.lit("a").alias("site_no"), F.timestamp_seconds(F.col("id") * 3600).alias("hour_updated"), F.col("id").alias("ord"))
    out = joins.weather_flow_outer_trim(weather, flow, ["site_no"], "ord").toPandas()
    hours = sorted(out.hour_updated.map(lambda t: t.value // 3600 // 10 ** 9))
    assert hours == list(range(5, 35))


@pytest.mark.parametrize("gap, block_days", [(60, 1), (7, 1), (60, 30), (2000, 1)])
def test_thinning_is_greedy(spark, readings, gap, block_days):
    df = spark.createDataFrame(readings[["k", "t", "id"]])
    kept = scenes.thin_by_gap(df, gap, "k", "t", "id", block_days).toPandas()
    for key, group in readings.sort_values(["t", "id"]).groupby("k"):
        want, last = [], None
        for t in group.t:
            if last is None or t - last >= timedelta(minutes=gap):
                want.append(t)
                last = t
        assert sorted(kept[kept.k == key].t) == want


def test_thinning_limit_and_state(spark):
    df = spark.range(100).select(F.lit("c").alias("k"), F.timestamp_seconds(F.col("id") * 600).alias("t"), "id")
    assert [r.id for r in scenes.thin_by_gap(df, 60, "k", "t", "id", max_images=3).orderBy("t").collect()] == [0, 6, 12]
    state = spark.createDataFrame([("c", datetime(1970, 1, 1, 10, 5))], "k string, since timestamp")
    assert scenes.thin_by_gap(df, 60, "k", "t", "id", state=state).agg(F.min("id")).collect()[0][0] == 61


def reference_panel(flow, width, min_observed, steps_per_day=1):
    """Slice choice on a dense daily series, one after the other."""
    if flow.notna().sum() < min_observed:
        return None
    out, first, last = [], flow.index[0], flow.index[-1]
    for season, month in (("winter", 12), ("spring", 3), ("summer", 6), ("fall", 9)):
        found = []
        for year in range(first.year, last.year + 1):
            start = pd.Timestamp(year, month, 1)
            end = start + pd.Timedelta(days=width - 1)
            if start >= first and end <= last:
                share = flow[start:end].notna().mean()
                if share >= 0.5:
                    found.append((share, year, start))
        if not found:
            return None
        out += [(season, s) for _, _, s in sorted(found, reverse=True)[:3]]
    peak = flow.idxmax()
    start = min(max(first, peak - pd.Timedelta(days=width // 2)), last - pd.Timedelta(days=width - 1))
    out.append(("flood", start))
    low = np.log1p(flow.clip(lower=0)).rolling(width, min_periods=width // 2).mean().round(9)
    out.append(("drought", low.idxmin() - pd.Timedelta(days=width - 1)))
    return out


def test_panels(spark):
    rng = np.random.default_rng(3)
    sites = {}
    for name, days, share in (("a", 1500, 0.9), ("b", 1200, 0.6), ("short", 300, 1.0), ("sparse", 1500, 0.3)):
        index = pd.date_range("2010-02-11", periods=days)
        flow = pd.Series(rng.integers(-3, 500, days).astype(float), index)
        flow[rng.random(days) > share] = np.nan
        sites[name] = flow[flow.first_valid_index():flow.last_valid_index()]
    rows = pd.concat([pd.DataFrame({"site_no": n, "date": f.index, "cfs": f.values}) for n, f in sites.items()]).dropna()
    steps = panels.to_steps(spark.createDataFrame(rows), "date", "cfs", step="day")
    chosen = panels.select_panel(steps, 92, "day", 3 * 180)
    got = chosen.withColumn("start", panels.step_time(F.col("start"), "day")).orderBy("site_no", "slice_order").toPandas()
    for name, flow in sites.items():
        want = reference_panel(flow, 92, 3 * 180)
        mine = got[got.site_no == name]
        assert list(zip(mine.slice_type, mine.start)) == (want or [])
    arrays = panels.panel_slices(chosen, steps, 92).collect()
    for r in arrays:
        start = pd.Timestamp("1970-01-01") + pd.Timedelta(days=r.start)
        want = sites[r.site_no].reindex(pd.date_range(start, periods=92))
        assert [None if np.isnan(x) else x for x in want] == r["values"]
    records = spark.createDataFrame([(n,) for n in [*sites, "none"]], "site_no string")
    done = spark.createDataFrame([("b",)], "site_no string")
    built = {r.site_no: r.status for r in panels.build_panels(records, steps, done, 92, "day", 3 * 180).collect()}
    assert built["a"] == "built" and built["b"] == "already_done" and built["short"] == "record_too_short" and built["none"] == "no_hourly_csv"


def haversine(lat1, lon1, lat2, lon2):
    a, b, c, d = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return np.round(2 * 6371.0 * np.arcsin(np.sqrt(h)), 6)


def test_nearest_and_best_over_the_globe(spark):
    rng = np.random.default_rng(11)
    crowd = np.column_stack([rng.uniform(40, 40.3, 60), rng.uniform(-105.3, -105, 60)])
    wide = np.column_stack([rng.uniform(-85, 85, 60), rng.uniform(-180, 180, 60)])
    places = np.round(np.vstack([crowd, wide, [[0.1, 179.95], [0.0, -179.9]]]), 4)
    stations = pd.DataFrame({"ord": range(len(places)), "station_id": [f"S{i}" for i in range(len(places))], "lat": places[:, 0], "lon": places[:, 1],
                             "begin_date": [f"{1980 + i % 7}-01-01" for i in range(len(places))]})
    asked = np.vstack([np.column_stack([rng.uniform(39, 41, 20), rng.uniform(-106, -104, 20)]), np.column_stack([rng.uniform(-89, 89, 40), rng.uniform(-180, 180, 40)]), [[0.0, 180.0]]])
    gauges = pd.DataFrame({"site_no": [f"G{i}" for i in range(len(asked))], "lat": asked[:, 0], "lon": asked[:, 1]})
    g, s = spark.createDataFrame(gauges), spark.createDataFrame(stations)
    near = {r.site_no: r for r in nearby.nearest_station(g, s).collect()}
    three = nearby.k_nearest_stations(g, s, 3).toPandas()
    best = {r.site_no: r for r in nearby.best_station(g, s, 75.0).collect()}
    for row in gauges.itertuples():
        km = haversine(row.lat, row.lon, stations.lat.to_numpy(), stations.lon.to_numpy())
        order = np.lexsort((stations.ord, km))
        assert near[row.site_no].station_id == f"S{order[0]}"
        assert three[three.site_no == row.site_no].sort_values("rank").station_id.tolist() == [f"S{i}" for i in order[:3]]
        within = stations[km <= 75.0].assign(km=km[km <= 75.0]).sort_values(["begin_date", "km", "ord"])
        assert best[row.site_no].station_id == (None if within.empty else within.station_id.iloc[0])


def test_neighbours_over_several_blocks(spark):
    rng = np.random.default_rng(5)
    bank = rng.normal(size=(200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(bank)], "site_no bigint, embedding array<float>")
    out = vectors.cosine_neighbours(df, 3, blocks=5).toPandas()
    unit = bank.astype(float) / np.linalg.norm(bank.astype(float), axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -2)
    for i in range(200):
        mine = out[out.site_no == i].sort_values("rank")
        assert mine.neighbour.tolist() == np.lexsort((np.arange(200), -sims[i]))[:3].tolist()
    assert len(out) == 600 and (out.neighbour != out.site_no).all()


def test_clusters(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)], "site_no bigint, embedding array<double>")
    out = vectors.kmeans_clusters(df, 3, 1).toPandas()
    assert len(out) == 40 and set(out.cluster) <= {0, 1, 2}


def brute_neighbours(bank, k):
    unit = bank.astype(float) / np.linalg.norm(bank.astype(float), axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -2)
    return [np.lexsort((np.arange(len(bank)), -row))[:k].tolist() for row in sims]


def test_neighbours_of_clusters_and_copies_visit_few_pairs(spark):
    """Forty tight clusters, and one vector that a third of all rows share."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 5
    bank = np.concatenate([centres[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 16)) * 0.05, np.tile(centres[0], (600, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(bank)] + [(9000, None), (9001, [0.0] * 16)], "site_no bigint, embedding array<double>")
    out = vectors.cosine_neighbours(df, 4, block_rows=60, pivots=50).toPandas().sort_values(["site_no", "rank"])
    assert out.groupby("site_no").neighbour.apply(list).tolist() == brute_neighbours(bank, 4)
    rows, pairs = vectors.neighbour_plan(df, 4, "site_no", "embedding", 60, 50)
    work = vectors.visited_pairs(rows, pairs).first()
    assert work["all_pairs"] == 1800 ** 2 and work["visited"] < 0.25 * work["all_pairs"]
    assert rows.groupBy("block").count().agg(F.max("count")).first()[0] < 130  # copies are dealt over many blocks


def test_neighbours_of_few_or_no_rows(spark):
    kinds = "site_no bigint, embedding array<double>"
    assert vectors.cosine_neighbours(spark.createDataFrame([(1, None)], kinds)).count() == 0
    assert vectors.cosine_neighbours(spark.createDataFrame([(1, [1.0, 0.0])], kinds)).count() == 0
    two = vectors.cosine_neighbours(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], kinds), 5).collect()
    assert sorted((r.site_no, r.rank, r.neighbour, r.sim) for r in two) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]


def test_clusters_equal_a_sequential_version(spark):
    rng = np.random.default_rng(9)
    bank = np.concatenate([rng.normal(size=(30, 5)) + 6 * np.eye(5)[i] for i in range(4)] + [np.tile(rng.normal(size=5), (50, 1))])
    x = np.floor(bank / np.sqrt((bank * bank).sum(1, keepdims=True)) * 1_000_000 + 0.5).astype(np.int64)
    centres = [x[0]]
    while len(centres) < 4:
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    for _ in range(6):
        own = np.array([((x - c) ** 2).sum(1) for c in centres]).argmin(0)
        centres = [(2 * x[own == i].sum(0) + (own == i).sum()) // (2 * (own == i).sum()) if (own == i).any() else centres[i] for i in range(4)]
    own = np.array([((x - c) ** 2).sum(1) for c in centres]).argmin(0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(bank)], "site_no bigint, embedding array<double>").repartition(5)
    out = vectors.kmeans_clusters(df, 4, 6, key="site_no").toPandas().sort_values("site_no")
    assert out.cluster.tolist() == own.tolist()
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)] + [(9, None)], "site_no bigint, embedding array<double>")
    assert {r.cluster for r in vectors.kmeans_clusters(same, 3).collect()} == {0}
    assert vectors.kmeans_clusters(same.limit(0), 3).count() == 0


def test_dedupe_keeps_first_chunk(spark):
    a = spark.createDataFrame([("s", 1, 10)], "site string, h int, v int")
    b = spark.createDataFrame([("s", 1, 20, "x"), ("s", 2, 30, "y")], "site string, h int, v int, extra string")
    out = series.dedupe_concat([a, b], ["site", "h"], ["v"]).orderBy("h").collect()
    assert [(r.h, r.v, r.extra) for r in out] == [(1, 10, None), (2, 30, "y")]


def test_block_records_and_trailing_frames(spark):
    """Gaps of whole blocks, negative steps, a null key and one step only."""
    rng, width = np.random.default_rng(5), 7
    steps = [("a", s, None if rng.random() < 0.2 else float(rng.integers(-2, 9))) for s in range(-20, 90)
             if rng.random() < 0.7 and not 20 < s < 45]
    steps += [("b", 3, 1.0), (None, 100, 2.0), ("none", 5, None)]
    known = {(k, s): v for k, s, v in steps}
    frame = spark.createDataFrame(steps, "k string, step long, v double")
    blocks = records.record_blocks(frame, ["k"], "step", "v", width)
    framed = records.lowest_frames(records.trailing_frames(blocks, ["k"], width), ["k"], width, 3, "low").collect()
    spans = {k: [s for x, s, _ in steps if x == k] for k in {x for x, _, _ in steps}}
    assert sorted((str(r["k"]), r["_block"]) for r in framed) == sorted(
        (str(k), b) for k, span in spans.items() for b in range(min(span) // width, max(span) // width + 1))

    def frame_of(k, s):
        return [v for v in (known.get((k, j)) for j in range(s - width + 1, s + 1)) if v is not None]

    def mean_of(values):
        return float(np.round(np.mean(np.log1p(np.maximum(values, 0))), 9))

    for r in framed:
        base, lo, hi = r["_block"] * width, min(spans[r["k"]]), max(spans[r["k"]])
        assert (r["lo"], r["hi"]) == (lo, hi)
        assert list(r["values"]) == [known.get((r["k"], base + i)) for i in range(width)]
        means = []
        for i, (n, s) in enumerate(zip(r["_n"], r["_s"])):
            seen = frame_of(r["k"], base + i)
            assert n == len(seen) and abs(s - sum(np.log1p(max(v, 0)) for v in seen) * records.LOG_UNITS) <= 2 * width
            if n >= 3 and lo <= base + i <= hi:
                means.append((mean_of(seen), base + i))
        low = r["low"] and (r["low"]["m"] / records.MEAN_UNITS, r["low"]["step"])
        assert low == (min(means) if means else None)
    rolled = series.rolling_log_mean(frame, ["k"], "step", "v", width, 3).filter("k = 'a'").collect()
    assert [r["step"] for r in sorted(rolled, key=lambda r: r["step"])] == list(range(min(spans["a"]), max(spans["a"]) + 1))
    for r in rolled:
        seen = frame_of("a", r["step"])
        assert r["log_mean"] == (mean_of(seen) if len(seen) >= 3 else None)
    covered = {r["step"]: r["coverage"] for r in series.rolling_coverage(frame, ["k"], "step", "v", width).filter("k = 'a'").collect()}
    first = min(spans["a"])
    assert covered == {s: None if s < first + width - 1 else len(frame_of("a", s)) / width for s in covered}


def test_slices_are_cut_from_blocks(spark):
    steps = [("a", s, float(s)) for s in range(10, 60) if s % 4]
    blocks = records.record_blocks(spark.createDataFrame(steps, "k string, step long, v double"), ["k"], "step", "v", 8)
    asked = spark.createDataFrame([("a", n, s) for n, s in enumerate((-40, 4, 8, 13, 55, 59, 400))] + [("b", 9, 16)], "k string, n int, start long")
    got = {(r["k"], r["n"]): r["values"] for r in records.cut_slices(asked, blocks, ["k"], "start", 8, "values").collect()}
    assert got == {(r["k"], r["n"]): [float(s) if r["k"] == "a" and 10 <= s < 60 and s % 4 else None for s in range(r["start"], r["start"] + 8)]
                   for r in asked.collect()}


def test_empty_records(spark):
    steps = spark.createDataFrame([], "site_no string, step long, cfs double")
    assert panels.select_panel(steps).count() == 0 and panels.flood_slice(steps).count() == 0
    assert series.rolling_coverage(steps, ["site_no"], "step", "cfs", 5).count() == 0


def test_hourly_panels(spark):
    """Two years of hours with gaps, against pandas."""
    rng = np.random.default_rng(8)
    index = pd.date_range("2010-02-11 05:00", periods=17_000, freq="h")
    flow = pd.Series(rng.integers(-3, 500, len(index)).astype(float), index)
    flow[rng.random(len(flow)) > 0.7] = np.nan
    flow["2010-07-01":"2010-11-20"] = np.nan
    rows = pd.DataFrame({"site_no": "a", "t": flow.index, "cfs": flow.values}).dropna()
    twice = pd.concat([rows, rows.assign(t=rows.t + pd.Timedelta(minutes=20))])  # two readings an hour
    steps = panels.to_steps(spark.createDataFrame(twice), "t", "cfs")
    chosen = panels.select_panel(steps, min_observed=6000)
    got = chosen.withColumn("start", panels.step_time(F.col("start"), "hour")).orderBy("slice_order").toPandas()
    flow = flow[flow.first_valid_index():flow.last_valid_index()]
    width = pd.Timedelta(hours=2208)
    want = []
    for season, month in (("winter", 12), ("spring", 3), ("summer", 6), ("fall", 9)):
        found = [(flow[s:s + width - pd.Timedelta(hours=1)].notna().mean(), s.year, s)
                 for s in (pd.Timestamp(y, month, 1) for y in range(2010, 2013))
                 if s >= flow.index[0] and s + width - pd.Timedelta(hours=1) <= flow.index[-1]]
        want += [(season, s) for share, _, s in sorted(found, reverse=True)[:3] if share >= 0.5]
    peak = flow.idxmax()
    want.append(("flood", min(max(flow.index[0], peak - width / 2), flow.index[-1] - width + pd.Timedelta(hours=1))))
    low = np.log1p(flow.clip(lower=0)).rolling(2208, min_periods=1104).mean().round(9)
    want.append(("drought", low.idxmin() - width + pd.Timedelta(hours=1)))
    assert list(zip(got.slice_type, got.start)) == want
    for r in panels.panel_slices(chosen, steps).collect():
        assert len(r["values"]) == 2208
        start = pd.Timestamp("1970-01-01") + pd.Timedelta(hours=r["start"])
        assert [None if np.isnan(x) else x for x in flow.reindex(pd.date_range(start, periods=2208, freq="h"))] == r["values"]
