"""Queries of panels over hours: slices of 2,208 values, three years of hourly readings at least."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.catalog.frames import hourly_iv
from freshet.catalog.registry import Inputs, query, rounded, stamp
from freshet.constants import SLICE_HOURS
from freshet.operators import panels, records, series
from freshet.session import stored
from freshet.sinks import tables as sinks

VIEWS = ("hourly_iv", "hours")
MIN_OBSERVED = 3 * 8760
BACK = f"INTERVAL '{SLICE_HOURS - 1}' HOUR"

# Means are taken over whole numbers, so that they are equal in any order of addition.
DENSE = """bounds AS (SELECT site, min(t) AS lo, max(t) AS hi, count(cfs) AS observed FROM hours GROUP BY site),
axis AS (SELECT site, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM bounds),
dense AS (SELECT site, t, cfs FROM axis LEFT JOIN hours USING (site, t))"""
ROLLED = DENSE + f""",
sums AS (SELECT site, t, cfs, count(*) OVER w AS n, count(cfs) OVER w AS k,
  sum(CAST(round(ln(1 + greatest(cfs, 0)) * {records.LOG_UNITS}) AS BIGINT)) OVER w AS s
  FROM dense WINDOW w AS (PARTITION BY site ORDER BY t ROWS BETWEEN {SLICE_HOURS - 1} PRECEDING AND CURRENT ROW)),
rolled AS (SELECT site, t, cfs, n, k, CASE WHEN k >= {SLICE_HOURS // 2} THEN CAST((2 * s + 100000 * k) // (200000 * k) AS DOUBLE) / 1000000000 END AS log_mean FROM sums)"""
SEASONS = f"""starts AS (SELECT b.site, y.year, s.season, s.place, CAST(make_date(y.year, s.month, 1) AS TIMESTAMP) AS start, b.lo, b.hi FROM bounds b,
  (SELECT unnest(range(1990, 2003)) AS year) y, (VALUES ('winter', 12, 1), ('spring', 3, 2), ('summer', 6, 3), ('fall', 9, 4)) s(season, month, place)),
coverage AS (SELECT s.site, s.season, s.place, s.year, s.start, count(f.cfs) AS n FROM starts s JOIN hours f
  ON f.site = s.site AND f.t BETWEEN s.start AND s.start + {BACK} WHERE s.start >= s.lo AND s.start + {BACK} <= s.hi GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site, season ORDER BY n DESC, year DESC) AS rank FROM coverage WHERE n >= {SLICE_HOURS // 2}),
seasons AS (SELECT * FROM ranked WHERE rank <= 3)"""
FLOOD = f"""peaks AS (SELECT f.site, arg_min(t, (-cfs, t)) AS peak, any_value(lo) AS lo, any_value(hi) AS hi FROM hours f JOIN bounds USING (site) WHERE cfs IS NOT NULL GROUP BY f.site),
flood AS (SELECT site, peak, least(greatest(lo, peak - INTERVAL '{SLICE_HOURS // 2}' HOUR), hi - {BACK}) AS start FROM peaks)"""
DROUGHT = """drought AS (SELECT site, arg_min(t, (log_mean, t)) AS hit FROM rolled WHERE log_mean IS NOT NULL GROUP BY site)"""
PANEL = f"""{ROLLED}, {SEASONS}, {FLOOD}, {DROUGHT},
usable AS (SELECT site FROM bounds WHERE observed >= {MIN_OBSERVED} AND site IN (SELECT site FROM seasons GROUP BY site HAVING count(DISTINCT season) = 4)),
panel AS (SELECT site, slice_type, rank, start, row_number() OVER (PARTITION BY site ORDER BY place, rank) AS slice_order FROM (
  SELECT site, season AS slice_type, place, rank, start FROM seasons UNION ALL SELECT site, 'flood', 5, 1, start FROM flood
  UNION ALL SELECT site, 'drought', 6, 1, hit - {BACK} FROM drought) JOIN usable USING (site))"""
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def hours(d: Inputs) -> DataFrame:
    return panels.to_steps(hourly_iv(d), "datetime", "cfs", "site", "hour")


def hour_blocks(d: Inputs) -> DataFrame:
    return panels.site_blocks(hours(d), SLICE_HOURS, "site")


def hour_text(column: str):
    return stamp(panels.step_time(F.col(column), "hour"))


def hour_panel(blocks: DataFrame) -> DataFrame:
    return panels.select_panel(blocks, SLICE_HOURS, "hour", MIN_OBSERVED, key="site")


@query("rolling_coverage_hours", f"""WITH {ROLLED}
SELECT site, {STAMP.format('t')} AS hour, CASE WHEN n = {SLICE_HOURS} THEN round(CAST(k AS DOUBLE) / {SLICE_HOURS}, 6) END AS coverage FROM rolled""", VIEWS)
def rolling_coverage_hours(d: Inputs) -> DataFrame:
    out = series.rolling_coverage(hours(d), ["site"], "step", "cfs", SLICE_HOURS)
    return out.select("site", hour_text("step").alias("hour"), *rounded("coverage"))


@query("rolling_log_mean_hours", f"""WITH {ROLLED} SELECT site, {STAMP.format('t')} AS hour, log_mean FROM rolled""", VIEWS)
def rolling_log_mean_hours(d: Inputs) -> DataFrame:
    out = series.rolling_log_mean(hours(d), ["site"], "step", "cfs", SLICE_HOURS, SLICE_HOURS // 2)
    return out.select("site", hour_text("step").alias("hour"), "log_mean")


@query("season_topk_hours", f"""WITH {DENSE}, {SEASONS}
SELECT site, season, rank, year, {STAMP.format('start')} AS start, round(CAST(n AS DOUBLE) / {SLICE_HOURS}, 6) AS coverage FROM seasons""", VIEWS)
def season_topk_hours(d: Inputs) -> DataFrame:
    out = panels.season_topk(hour_blocks(d), SLICE_HOURS, "hour", key="site")
    return out.select("site", "season", "rank", "year", hour_text("start").alias("start"), *rounded("coverage"))


@query("flood_slice_hours", f"""WITH {DENSE}, {FLOOD}
SELECT site, {STAMP.format('peak')} AS peak, {STAMP.format('start')} AS start FROM flood""", VIEWS)
def flood_slice_hours(d: Inputs) -> DataFrame:
    return panels.flood_slice(hour_blocks(d), SLICE_HOURS, "site").select("site", hour_text("peak").alias("peak"), hour_text("start").alias("start"))


@query("drought_slice_hours", f"""WITH {ROLLED}, {DROUGHT}
SELECT site, {STAMP.format('hit')} AS low_end, {STAMP.format('hit - ' + BACK)} AS start FROM drought""", VIEWS)
def drought_slice_hours(d: Inputs) -> DataFrame:
    out = panels.drought_slice(hour_blocks(d), SLICE_HOURS, key="site")
    return out.select("site", hour_text("end").alias("low_end"), hour_text("start").alias("start"))


@query("select_panel_hours", f"""WITH {PANEL} SELECT site, slice_order, slice_type, rank, {STAMP.format('start')} AS start FROM panel""", VIEWS)
def select_panel_hours(d: Inputs) -> DataFrame:
    return hour_panel(hour_blocks(d)).select("site", "slice_order", "slice_type", "rank", hour_text("start").alias("start"))


@query("panel_slices_hours", f"""WITH {PANEL}
SELECT p.site, slice_order, {STAMP.format('p.start')} AS start, CAST(o.off AS INT) AS off, CAST(f.cfs AS FLOAT) AS cfs
FROM panel p CROSS JOIN range({SLICE_HOURS}) o(off) LEFT JOIN hours f ON f.site = p.site AND f.t = p.start + to_hours(CAST(o.off AS INT))""", VIEWS)
def panel_slices_hours(d: Inputs) -> DataFrame:
    blocks = stored(hour_blocks(d), "hour_blocks")
    out = panels.panel_slices(hour_panel(blocks), blocks, SLICE_HOURS, "site")
    return out.select("site", "slice_order", hour_text("start").alias("start"), F.posexplode("values").alias("off", "cfs"))


@query("build_panels_hours", f"""WITH {PANEL}
SELECT site, CASE WHEN site % 5 = 4 THEN 'already_done' WHEN site NOT IN (SELECT site FROM hours) THEN 'no_hourly_csv'
  WHEN site NOT IN (SELECT site FROM usable) THEN 'record_too_short' ELSE 'built' END AS status,
  CASE WHEN site % 5 <> 4 AND site IN (SELECT site FROM usable) THEN (SELECT count(*) FROM panel p WHERE p.site = r.site) END AS slices
FROM (SELECT s_suppkey AS site FROM supplier UNION ALL SELECT 0) r""", VIEWS)
def build_panels_hours(d: Inputs) -> DataFrame:
    suppliers = d.table("supplier").select(F.col("s_suppkey").alias("site"))
    embedded = suppliers.union(d.spark.range(1).select(F.col("id").cast(suppliers.dtypes[0][1]).alias("site")))
    out = panels.build_panels(embedded, hours(d), embedded.filter(F.col("site") % 5 == 4), SLICE_HOURS, "hour", MIN_OBSERVED, "site")
    return out.select("site", "status", F.when(F.col("panel").isNotNull(), F.size("panel")).cast("bigint").alias("slices"))


@query("write_panels_hours", f"""WITH {PANEL}
SELECT p.site, slice_order, slice_type, count(f.cfs) AS known, round(CAST(sum(CAST(f.cfs AS FLOAT)) AS DOUBLE), 2) AS total
FROM panel p LEFT JOIN hours f ON f.site = p.site AND f.t BETWEEN p.start AND p.start + {BACK} GROUP BY ALL""", VIEWS)
def write_panels_hours(d: Inputs) -> DataFrame:
    steps = hours(d)
    built = panels.build_panels(steps.select("site").distinct(), steps, steps.select("site").limit(0), SLICE_HOURS, "hour", MIN_OBSERVED, "site")
    path = d.scratch("panels")
    sinks.write_panels(built, path)
    back = d.spark.read.parquet(path).select("site", F.inline("panel"))
    total = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)).cast("double"))
    return back.select("site", "slice_order", "slice_type", F.size(F.filter("values", lambda x: x.isNotNull())).cast("bigint").alias("known"),
                       F.round(total, 2).alias("total"))
