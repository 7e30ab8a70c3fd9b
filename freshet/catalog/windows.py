"""Queries of fills, rolling frames, panels, scene choices and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.catalog.aggregates import IMAGES, camera_images
from freshet.catalog.frames import joined
from freshet.catalog.linking import SNOW, daily_snow
from freshet.catalog.frames import flow_hourly
from freshet.catalog.registry import Inputs, query, rounded, stamp
from freshet.catalog.views import JOINED
from freshet.functions import text
from freshet.operators import clean, joins, panels, scenes, series
from freshet.session import stored

# Panels over daily steps: 92-day slices, three years of readings at least.
WIDTH, MIN_OBSERVED = 92, 3 * 365
DENSE = """bounds AS (SELECT site, min(date) AS lo, max(date) AS hi, count(*) AS observed FROM daily_flow GROUP BY site),
axis AS (SELECT site, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
dense AS (SELECT site, date, cfs FROM axis LEFT JOIN daily_flow USING (site, date))"""
ROLLED = DENSE + """,
rolled AS (SELECT site, date, cfs, count(*) OVER w AS n, count(cfs) OVER w AS k,
  CASE WHEN count(cfs) OVER w >= 46 THEN round(avg(CASE WHEN cfs IS NOT NULL THEN ln(1 + greatest(cfs, 0)) END) OVER w, 9) END AS log_mean
  FROM dense WINDOW w AS (PARTITION BY site ORDER BY date ROWS BETWEEN 91 PRECEDING AND CURRENT ROW))"""
SEASONS = """starts AS (SELECT b.site, y.year, s.season, s.place, make_date(y.year, s.month, 1) AS start, b.lo, b.hi FROM bounds b,
  (SELECT CAST(unnest(range(1994, 2003)) AS BIGINT) AS year) y,
  (VALUES ('winter', 12, 1), ('spring', 3, 2), ('summer', 6, 3), ('fall', 9, 4)) s(season, month, place)),
coverage AS (SELECT s.site, s.season, s.place, s.year, s.start, count(f.cfs) AS n FROM starts s JOIN daily_flow f
  ON f.site = s.site AND f.date BETWEEN s.start AND s.start + 91 WHERE s.start >= s.lo AND s.start + 91 <= s.hi GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site, season ORDER BY n DESC, year DESC) AS rank FROM coverage WHERE n >= 46),
seasons AS (SELECT * FROM ranked WHERE rank <= 3)"""
FLOOD = """peaks AS (SELECT f.site, arg_min(date, (-cfs, date)) AS peak, any_value(lo) AS lo, any_value(hi) AS hi FROM daily_flow f JOIN bounds USING (site) GROUP BY f.site),
flood AS (SELECT site, peak, least(greatest(lo, peak - 46), hi - 91) AS start FROM peaks)"""
DROUGHT = """drought AS (SELECT site, arg_min(date, (log_mean, date)) AS hit FROM rolled WHERE log_mean IS NOT NULL GROUP BY site)"""
PANEL = f"""{ROLLED}, {SEASONS}, {FLOOD}, {DROUGHT},
usable AS (SELECT site FROM bounds WHERE observed >= {MIN_OBSERVED} AND site IN (SELECT site FROM seasons GROUP BY site HAVING count(DISTINCT season) = 4)),
panel AS (SELECT site, slice_type, rank, start, row_number() OVER (PARTITION BY site ORDER BY place, rank) AS slice_order FROM (
  SELECT site, season AS slice_type, place, rank, start FROM seasons UNION ALL SELECT site, 'flood', 5, 1, start FROM flood
  UNION ALL SELECT site, 'drought', 6, 1, hit - 91 FROM drought) JOIN usable USING (site))"""


def steps(d: Inputs) -> DataFrame:
    return panels.to_steps(d.view("daily_flow").withColumn("ts", F.col("date").cast("timestamp")), "ts", "cfs", "site", "day")


def day_blocks(d: Inputs) -> DataFrame:
    return panels.site_blocks(steps(d), WIDTH, "site")


def day_text(column: str):
    return F.date_from_unix_date(F.col(column).cast("int")).cast("string")


FILLS = f"""snow AS ({SNOW}), j AS (SELECT j.site_no, j.hour_updated, j.ord, s.snow_depth FROM joined j LEFT JOIN snow s
  ON s.site_no = j.site_no AND CAST(s.day AS TIMESTAMP) = j.hour_updated),
p AS (SELECT *, row_number() OVER w AS pos, last_value(snow_depth IGNORE NULLS) OVER b AS bv, first_value(snow_depth IGNORE NULLS) OVER a AS av FROM j
  WINDOW w AS (PARTITION BY site_no ORDER BY hour_updated, ord), b AS (PARTITION BY site_no ORDER BY hour_updated, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  a AS (PARTITION BY site_no ORDER BY hour_updated, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
q AS (SELECT *, last_value(CASE WHEN snow_depth IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS bp, first_value(CASE WHEN snow_depth IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS ap FROM p
  WINDOW b AS (PARTITION BY site_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY site_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def snowed(d: Inputs) -> DataFrame:
    return joins.snow_left(joined(d), daily_snow(flow_hourly(d)))


ORDER = ("hour_updated", "ord")


@query("fill_nearest", f"""WITH {FILLS}
SELECT site_no, ord, CASE WHEN ap IS NULL OR pos - bp <= ap - pos THEN bv ELSE av END AS filled_snow FROM q""", JOINED)
def fill_nearest(d: Inputs) -> DataFrame:
    out = series.fill_nearest(snowed(d), ["site_no"], [F.col(c) for c in ORDER], F.to_date("hour_updated"), "snow_depth", "filled_snow")
    return out.select("site_no", "ord", "filled_snow")


@query("fill_mean_of_neighbours", """
WITH n AS (SELECT station, ord, valid, TRY_CAST(tmpf AS DOUBLE) AS tmpf, TRY_CAST(p01m AS DOUBLE) AS p01m FROM asos_raw)
SELECT station, ord, coalesce(p01m, 0) AS p01m, round((last_value(tmpf IGNORE NULLS) OVER (PARTITION BY station ORDER BY valid, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  + first_value(tmpf IGNORE NULLS) OVER (PARTITION BY station ORDER BY valid, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / 2, 6) AS tmpf_filled FROM n""", ["asos_raw"])
def fill_mean_of_neighbours(d: Inputs) -> DataFrame:
    rows = clean.coerce_numeric(d.view("asos_raw"), ["tmpf", "p01m"])
    out = series.fill_mean_of_neighbours(rows, ["station"], [F.col("valid"), F.col("ord")], F.substring("valid", 1, 10), "tmpf", "tmpf_filled")
    return out.select("station", "ord", F.coalesce("p01m", F.lit(0.0)).alias("p01m"), *rounded("tmpf_filled"))


@query("rolling_coverage", f"""WITH {ROLLED}
SELECT site, strftime(date, '%Y-%m-%d') AS date, CASE WHEN n = 92 THEN round(CAST(k AS DOUBLE) / 92, 6) END AS coverage FROM rolled""", ["daily_flow"])
def rolling_coverage(d: Inputs) -> DataFrame:
    out = series.rolling_coverage(steps(d), ["site"], "step", "cfs", WIDTH)
    return out.select("site", day_text("step").alias("date"), *rounded("coverage"))


@query("rolling_log_mean", f"""WITH {ROLLED}
SELECT site, strftime(date, '%Y-%m-%d') AS date, log_mean FROM rolled""", ["daily_flow"])
def rolling_log_mean(d: Inputs) -> DataFrame:
    out = series.rolling_log_mean(steps(d), ["site"], "step", "cfs", WIDTH, WIDTH // 2)
    return out.select("site", day_text("step").alias("date"), "log_mean")


@query("season_topk", f"""WITH {DENSE}, {SEASONS}
SELECT site, season, rank, year, strftime(start, '%Y-%m-%d') AS start, round(CAST(n AS DOUBLE) / 92, 6) AS coverage FROM seasons""", ["daily_flow"])
def season_topk(d: Inputs) -> DataFrame:
    out = panels.season_topk(day_blocks(d), WIDTH, "day", key="site")
    return out.select("site", "season", "rank", "year", day_text("start").alias("start"), *rounded("coverage"))


@query("flood_slice", f"""WITH {DENSE}, {FLOOD}
SELECT site, strftime(peak, '%Y-%m-%d') AS peak, strftime(start, '%Y-%m-%d') AS start FROM flood""", ["daily_flow"])
def flood_slice(d: Inputs) -> DataFrame:
    return panels.flood_slice(day_blocks(d), WIDTH, "site").select("site", day_text("peak").alias("peak"), day_text("start").alias("start"))


@query("drought_slice", f"""WITH {ROLLED}, {DROUGHT}
SELECT site, strftime(hit, '%Y-%m-%d') AS low_end, strftime(hit - 91, '%Y-%m-%d') AS start FROM drought""", ["daily_flow"])
def drought_slice(d: Inputs) -> DataFrame:
    return panels.drought_slice(day_blocks(d), WIDTH, key="site").select("site", day_text("end").alias("low_end"), day_text("start").alias("start"))


def panel(blocks: DataFrame) -> DataFrame:
    return panels.select_panel(blocks, WIDTH, "day", MIN_OBSERVED, key="site")


@query("select_panel", f"""WITH {PANEL} SELECT site, slice_order, slice_type, rank, strftime(start, '%Y-%m-%d') AS start FROM panel""", ["daily_flow"])
def select_panel(d: Inputs) -> DataFrame:
    return panel(day_blocks(d)).select("site", "slice_order", "slice_type", "rank", day_text("start").alias("start"))


@query("panel_slices", f"""WITH {PANEL}
SELECT p.site, slice_order, strftime(p.start, '%Y-%m-%d') AS start, CAST(o.off AS INT) AS off, CAST(f.cfs AS FLOAT) AS cfs FROM panel p
CROSS JOIN range(92) o(off) LEFT JOIN daily_flow f ON f.site = p.site AND f.date = p.start + CAST(o.off AS INT)""", ["daily_flow"])
def panel_slices(d: Inputs) -> DataFrame:
    blocks = stored(day_blocks(d), "day_blocks")
    out = panels.panel_slices(panel(blocks), blocks, WIDTH, "site")
    return out.select("site", "slice_order", day_text("start").alias("start"), F.posexplode("values").alias("off", "cfs"))


@query("build_panels", f"""WITH {PANEL}
SELECT site, CASE WHEN site % 5 = 3 THEN 'already_done' WHEN site NOT IN (SELECT site FROM daily_flow) THEN 'no_hourly_csv'
  WHEN site NOT IN (SELECT site FROM usable) THEN 'record_too_short' ELSE 'built' END AS status,
  CASE WHEN site % 5 <> 3 AND site IN (SELECT site FROM usable) THEN (SELECT count(*) FROM panel p WHERE p.site = r.site) END AS slices
FROM (SELECT s_suppkey AS site FROM supplier) r""", ["daily_flow"])
def build_panels(d: Inputs) -> DataFrame:
    records = d.table("supplier").select(F.col("s_suppkey").alias("site"))
    done = records.filter(F.col("site") % 5 == 3)
    out = panels.build_panels(records, steps(d), done, WIDTH, "day", MIN_OBSERVED, "site")
    return out.select("site", "status", F.when(F.col("panel").isNotNull(), F.size("panel")).cast("bigint").alias("slices"))


@query("daily_history", """
WITH axis AS (SELECT site, CAST(unnest(generate_series(DATE '1990-01-01', DATE '2004-12-31', INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT site FROM daily_flow)),
k AS (SELECT site, count(*) AS days FROM daily_flow WHERE date BETWEEN DATE '1990-01-01' AND DATE '2004-12-31' GROUP BY site)
SELECT site, CAST(date - DATE '1990-01-01' AS INT) AS off, CAST(cfs AS FLOAT) AS cfs, days, CASE WHEN days < 1460 THEN 'short_history' ELSE 'ok' END AS status
FROM axis LEFT JOIN daily_flow USING (site, date) JOIN k USING (site)""", ["daily_flow"])
def daily_history(d: Inputs) -> DataFrame:
    out = panels.daily_history(d.view("daily_flow"), "1990-01-01", "2004-12-31", 1460, "site")
    return out.select("site", F.posexplode("history").alias("off", "cfs"), F.col("history_days").alias("days"), "status")


CLEAREST = """r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY cloud_percent, ord) AS k FROM scenes),
best AS (SELECT site, arg_min(product_id, k) FILTER (WHERE valid_fraction > 0.5) AS product_id,
  arg_min(cloud_percent, k) FILTER (WHERE valid_fraction > 0.5) AS cloud_percent FROM r WHERE k <= 3 GROUP BY site)"""


@query("clearest_scene", f"""WITH {CLEAREST}
SELECT CAST(n_nationkey + 5 AS BIGINT) AS site, product_id, cloud_percent, CASE WHEN b.site IS NULL THEN 'no_sentinel_scenes' WHEN product_id IS NULL THEN 'no_valid_patch' ELSE 'ok' END AS status
FROM nation LEFT JOIN best b ON b.site = n_nationkey + 5""", ["scenes"])
def clearest_scene(d: Inputs) -> DataFrame:
    sites = d.table("nation").select((F.col("n_nationkey") + 5).cast("bigint").alias("site"))
    return scenes.scene_status(sites, d.view("scenes"), "site").select("site", "product_id", "cloud_percent", "status")


@query("dedupe_concat", """
WITH f AS (SELECT site_no, hour_updated, ord, cfs, CAST(month(hour_updated) <> 10 AS INT) AS chunk FROM flow_hourly),
r AS (SELECT *, row_number() OVER (PARTITION BY site_no, hour_updated ORDER BY chunk, ord) AS k FROM f)
SELECT site_no, strftime(hour_updated, '%Y-%m-%d %H:%M:%S') AS hour_updated, ord, cfs FROM r WHERE k = 1""", ("iv_raw", "flow_utc", "flow_hourly"))
def dedupe_concat(d: Inputs) -> DataFrame:
    flow = flow_hourly(d)
    early = flow.filter(F.month("hour_updated") == 10)
    # Chunks overlap: the second one repeats some hours of the first.
    late = flow.filter((F.month("hour_updated") != 10) | (F.col("ord") % 2 == 0))
    out = series.dedupe_concat([early, late], ["site_no", "hour_updated"], ["ord"])
    return out.select("site_no", stamp("hour_updated").alias("hour_updated"), "ord", "cfs")


@query("parse_scene_id", """
SELECT ord, CASE WHEN ord % 10 = 0 THEN NULL ELSE substr(product_id, 1, 3) END AS satellite,
  CASE WHEN ord % 10 = 0 THEN NULL ELSE strftime(strptime(substr(product_id, 12, 15), '%Y%m%dT%H%M%S'), '%Y-%m-%d %H:%M:%S') END AS sensing_time,
  CASE WHEN ord % 10 = 0 THEN NULL ELSE substr(product_id, 35, 3) END AS orbit, CASE WHEN ord % 10 = 0 THEN NULL ELSE substr(product_id, 40, 5) END AS tile FROM scenes""", ["scenes"])
def parse_scene_id(d: Inputs) -> DataFrame:
    ids = d.view("scenes").select("ord", F.when(F.col("ord") % 10 == 0, F.replace("product_id", F.lit("MSIL1C"), F.lit("MSIL2A"))).otherwise(F.col("product_id")).alias("p"))
    f = text.scene_fields(F.col("p"))
    return ids.select("ord", f["satellite"].alias("satellite"), stamp(f["sensing_time"]).alias("sensing_time"), f["orbit"].alias("orbit"), f["tile"].alias("tile"))


@query("normalise_name", """
SELECT c_custkey, 'co_' || trim(regexp_replace(split_part(lower(nm), ',', 1), '[^a-z0-9]+', '_', 'g'), '_') AS name
FROM (SELECT c_custkey, ' ' || c_mktsegment || ' #R.' || c_name || ', CO.' AS nm FROM customer)""")
def normalise_name(d: Inputs) -> DataFrame:
    nm = F.concat(F.lit(" "), "c_mktsegment", F.lit(" #R."), "c_name", F.lit(", CO."))
    return d.table("customer").select("c_custkey", text.normalise_name(nm, F.lit("CO")).alias("name"))


@query("parse_triplet_and_ids", """
SELECT c_custkey, CAST(c_custkey AS STRING) AS in_parentheses, CAST(c_custkey AS STRING) AS station, 'CO' AS state, 'SNTL' AS network,
  'tiles/' || CAST(1 + c_custkey % 60 AS STRING) || '/T/DE/' AS prefix FROM customer""")
def parse_triplet_and_ids(d: Inputs) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    parts = text.triplet_parts(F.concat(key, F.lit(":CO:SNTL")))
    tile = F.concat(F.lpad((F.col("c_custkey") % 60 + 1).cast("string"), 2, "0"), F.lit("TDE"))
    return d.table("customer").select("c_custkey", text.text_in_parentheses(F.concat("c_name", F.lit(" ("), key, F.lit(")"))).alias("in_parentheses"),
                                      parts["station"].alias("station"), parts["state"].alias("state"), parts["network"].alias("network"),
                                      text.tile_prefix(tile).alias("prefix"))


@query("thin_by_gap", f"""
WITH RECURSIVE images AS ({IMAGES}), one AS MATERIALIZED (SELECT camera_id, t, min(key) AS key FROM images GROUP BY 1, 2),
nxt AS MATERIALIZED (SELECT a.camera_id, a.t, b.t AS after FROM one a ASOF JOIN one b ON a.camera_id = b.camera_id AND a.t + INTERVAL '60' MINUTE <= b.t),
chain AS (SELECT camera_id, min(t) AS t FROM one GROUP BY 1 UNION ALL SELECT c.camera_id, n.after FROM chain c JOIN nxt n ON n.camera_id = c.camera_id AND n.t = c.t WHERE n.after IS NOT NULL)
SELECT camera_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime, key FROM chain JOIN one USING (camera_id, t)""", ["camera_keys"])
def thin_by_gap(d: Inputs) -> DataFrame:
    kept = scenes.thin_by_gap(camera_images(d), 60, block_days=3)
    return kept.select("camera_id", stamp("datetime").alias("datetime"), "key")


@query("top_n_scenes", """
WITH r AS (SELECT site, ord, row_number() OVER (PARTITION BY site ORDER BY strptime(substr(product_id, 12, 15), '%Y%m%dT%H%M%S'), ord) AS rank
  FROM scenes WHERE cloud_percent <= 80 AND valid_fraction >= 0.05)
SELECT * FROM r WHERE rank <= 5""", ["scenes"])
def top_n_scenes(d: Inputs) -> DataFrame:
    timed = d.view("scenes").withColumn("sensing_time", text.scene_fields(F.col("product_id"))["sensing_time"])
    return scenes.top_n_scenes(clean.cloud_filter(timed, 80.0), 5, "site").select("site", "ord", "rank")


PERIODS = """SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY o_custkey HAVING min(o_orderdate) < max(o_orderdate)"""


def periods(d: Inputs) -> DataFrame:
    return (d.table("orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("start"), F.max(F.to_date("o_orderdate")).alias("end"))
            .filter(F.col("start") < F.col("end")))


CHUNKS = f"""c AS (SELECT o_custkey, b, greatest(a, CAST(h AS DATE)) AS s, least(b, CAST(h + INTERVAL 6 MONTH AS DATE)) AS e FROM (
  SELECT o_custkey, a, b, unnest(generate_series(date_trunc('month', a), CAST(b - 1 AS TIMESTAMP), INTERVAL 6 MONTH)) AS h FROM ({PERIODS})))"""


@query("calendar_chunks", f"""WITH {CHUNKS}
SELECT o_custkey, strftime(s, '%Y-%m-%d') AS chunk_start, strftime(e, '%Y-%m-%d') AS chunk_end FROM c""")
def calendar_chunks(d: Inputs) -> DataFrame:
    out = series.calendar_chunks(periods(d), 6)
    return out.select("o_custkey", F.col("chunk_start").cast("string").alias("chunk_start"), F.col("chunk_end").cast("string").alias("chunk_end"))


@query("progress_by_day", """
WITH day AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem))
SELECT strftime(day, '%Y-%m-%d') AS day FROM day WHERE (month(day) >= 10 OR month(day) * 100 + day(day) <= 715) AND day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 4 = 0)""")
def progress_by_day(d: Inputs) -> DataFrame:
    span = d.table("lineitem").agg(F.min(F.to_date("l_shipdate")).alias("start"), F.max(F.to_date("l_shipdate")).alias("end"))
    done = d.table("orders").filter(F.col("o_orderkey") % 4 == 0).select(F.to_date("o_orderdate").alias("day"))
    return series.progress_by_day(span, done).select(F.col("day").cast("string").alias("day"))


LISTING = """SELECT ord, 'tiles/13/T/DE/' || CASE WHEN ord % 10 = 0 THEN replace(product_id, 'MSIL1C', 'MSIL2A') ELSE product_id END || '.SAFE/' AS prefix FROM scenes"""


def scene_prefixes(d: Inputs) -> DataFrame:
    named = F.when(F.col("ord") % 10 == 0, F.replace("product_id", F.lit("MSIL1C"), F.lit("MSIL2A"))).otherwise(F.col("product_id"))
    return d.view("scenes").select("ord", F.concat(F.lit("tiles/13/T/DE/"), named, F.lit(".SAFE/")).alias("prefix"))


@query("scene_listing", """
SELECT ord, product_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS sensing_time,
  'tiles/13/T/DE/' || product_id || '.SAFE/GRANULE/L1C_T13TDE_A0/IMG_DATA/T13TDE_' || substr(product_id, 12, 15) || '_B04.jp2' AS path
FROM (SELECT ord, product_id, strptime(substr(product_id, 12, 15), '%Y%m%dT%H%M%S') AS t FROM scenes WHERE ord % 10 <> 0)
WHERE t BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-06-30 12:30:00'""", ["scenes"])
def scene_listing(d: Inputs) -> DataFrame:
    prefixes = scene_prefixes(d)
    folders = prefixes.select("prefix", F.explode(F.array(F.lit("A1"), F.lit("A0"))).alias("g")).select(
        "prefix", F.concat("prefix", F.lit("GRANULE/L1C_T13TDE_"), "g", F.lit("/")).alias("granule_prefix"))
    listed = scenes.scene_listing(prefixes, start="1996-01-01", end="1999-06-30 12:30:00")
    full = listed.join(scenes.first_granules(folders), "prefix")
    return full.select("ord", "product_id", stamp("sensing_time").alias("sensing_time"),
                       scenes.band_path(F.col("granule_prefix"), F.col("product_id"), "B04").alias("path"))


@query("camera_listing", f"""WITH images AS ({IMAGES})
SELECT ord, key, strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime FROM images WHERE ord % 7 <> 0 AND t BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""", ["camera_keys"])
def camera_listing(d: Inputs) -> DataFrame:
    keys = d.view("camera_keys").withColumn("key", F.when(F.col("ord") % 7 == 0, F.concat("key", F.lit(".tmp"))).otherwise(F.col("key")))
    out = scenes.camera_listing(keys, start="2024-01-10", end="2024-01-20")
    return out.select("ord", "key", stamp("datetime").alias("datetime"))


@query("list_cameras", """
SELECT DISTINCT split_part(key, '/', 2) AS camera_id FROM camera_keys WHERE starts_with(key, 'overlay/CO_')""", ["camera_keys"])
def list_cameras(d: Inputs) -> DataFrame:
    return scenes.list_cameras(d.view("camera_keys"), state="CO")
