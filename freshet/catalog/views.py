"""Input views over the given tables, in SQL that Spark and DuckDB both run, and shared SQL steps."""

_OBS = """SELECT 'K' || lpad(CAST(user_id % 20 AS STRING), 3, '0') AS station, event_id AS ord,
       substr(CAST({ts} AS STRING), 1, 16) AS valid,
       CASE WHEN event_id % 37 = 0 THEN 'M' ELSE CAST(value AS STRING) END AS tmpf,
       CASE WHEN event_id % 41 = 0 THEN 'M' ELSE CAST(user_id % 60 AS STRING) END AS dwpf,
       CASE WHEN event_id % 29 = 0 THEN 'M' WHEN event_id % 23 = 0 THEN 'T'
            ELSE CAST(event_id % 7 AS STRING) END AS p01m,
       CASE WHEN event_id % 3 = 0 THEN 'M' ELSE CAST(event_id % 1013 AS STRING) END AS mslp,
       event_type AS skyc1
FROM events"""

# name -> (table, SQL)
VIEWS = {
    # Raw weather readings.
    "asos_raw": ("events", _OBS.format(ts="ts")),
    # The same readings in the season of the flow readings.
    "asos_fall": ("events", _OBS.format(ts="ts + INTERVAL '290' DAY")),
    # Local-clock flow readings that cross the end of daylight time.
    "iv_raw": ("events", """SELECT lpad(CAST(10000000 + user_id % 12 AS STRING), 8, '0') AS site_no, event_id AS ord,
       substr(CAST(date_trunc('hour', ts) + INTERVAL '290' DAY AS STRING), 1, 14)
         || CASE event_id % 4 WHEN 0 THEN '00' WHEN 1 THEN '15' WHEN 2 THEN '30' ELSE '45' END AS datetime,
       CASE (user_id % 12) % 4 WHEN 0 THEN 'EST' WHEN 1 THEN 'CST' WHEN 2 THEN 'MST' ELSE 'PST' END AS tz_cd,
       CASE WHEN event_id % 31 = 0 THEN 'Ice' ELSE CAST(value AS STRING) END AS cfs
FROM events"""),
    "gauges": ("supplier", """SELECT lpad(CAST(10000000 + s_suppkey AS STRING), 8, '0') AS site_no, s_name AS station_nm,
       37 + CAST((s_suppkey * 7919) % 4000 AS DOUBLE) / 1000 AS lat,
       -109 + CAST((s_suppkey * 104729) % 7000 AS DOUBLE) / 1000 AS lon, s_nationkey AS state_cd
FROM supplier"""),
    "stations": ("customer", """SELECT c_custkey AS ord, 'S' || CAST(c_custkey AS STRING) AS station_id,
       (36500 + CAST((c_custkey * 7907) % 5000 AS DOUBLE)) / 1000 AS lat,
       (-109500 + CAST((c_custkey * 104723) % 8000 AS DOUBLE)) / 1000 AS lon, c_nationkey AS state_cd,
       CAST(1980 + c_custkey % 40 AS STRING) || '-01-01' AS begin_date
FROM customer"""),
    # One snow grid, 50 columns wide, north to south.
    "cells": ("part", """SELECT p_partkey AS cell_id, CAST(floor(p_partkey / 50) AS BIGINT) AS row, p_partkey % 50 AS col,
       41 - CAST(floor(p_partkey / 50) AS DOUBLE) / 40 AS lat,
       -106 + CAST(p_partkey % 50 AS DOUBLE) / 40 AS lon,
       CASE WHEN p_partkey % 17 = 0 THEN -9999 ELSE p_size * 10 END AS swe_raw,
       1000 + (p_partkey * 37) % 2500 AS elevation_m
FROM part"""),
    "daily_flow": ("lineitem", """SELECT l_suppkey % 10 AS site, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS cfs
FROM lineitem GROUP BY l_suppkey % 10, CAST(l_shipdate AS DATE)"""),
    "registry": ("orders", """SELECT CAST(o_orderkey AS STRING) AS site_no, o_custkey % 50 AS state,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status
FROM orders"""),
    "scenes": ("orders", """SELECT o_orderkey AS ord, o_custkey % 25 AS site,
       'S2' || CASE o_orderkey % 2 WHEN 0 THEN 'A' ELSE 'B' END || '_MSIL1C_'
         || replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') || 'T'
         || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || '3000_N0510_R'
         || lpad(CAST(o_orderkey % 143 AS STRING), 3, '0') || '_T13TDE_20240101T000000' AS product_id,
       o_custkey % 101 AS cloud_percent, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS valid_fraction
FROM orders"""),
    "camera_keys": ("events", """SELECT event_id AS ord, 'overlay/CO_Cam_' || CAST(user_id % 8 AS STRING) || '/CO_Cam_'
         || CAST(user_id % 8 AS STRING) || '___' || substr(CAST(ts AS STRING), 1, 10) || 'T'
         || replace(substr(CAST(ts AS STRING), 12, 8), ':', '-') || 'Z.jpg' AS key
FROM events"""),
}

_ZONE = ("CASE arg_min(tz_cd, ord) WHEN 'EST' THEN 'America/New_York' WHEN 'CST' THEN 'America/Chicago'"
         " WHEN 'MST' THEN 'America/Denver' WHEN 'PST' THEN 'America/Los_Angeles' END")


def _folded(view: str) -> str:
    hour = ("CASE WHEN substr(valid, 15, 2) = '00' THEN CAST(valid || ':00' AS TIMESTAMP)"
            " ELSE date_trunc('hour', CAST(valid || ':00' AS TIMESTAMP)) + INTERVAL '1' HOUR END")
    return f"""SELECT station, {hour} AS hour_updated, arg_min(valid, ord) AS valid,
  coalesce(sum(TRY_CAST(p01m AS DOUBLE)), 0) AS p01m, avg(TRY_CAST(tmpf AS DOUBLE)) AS tmpf,
  avg(TRY_CAST(dwpf AS DOUBLE)) AS dwpf,
  arg_min(TRY_CAST(mslp AS DOUBLE), ord) FILTER (WHERE TRY_CAST(mslp AS DOUBLE) IS NOT NULL) AS mslp,
  arg_min(skyc1, ord) AS skyc1
FROM {view} GROUP BY 1, 2"""


# Shared steps of the SQL texts (DuckDB).
CTES = {
    "flow_utc": f"""SELECT r.site_no, r.ord, r.datetime, r.tz_cd,
  (CAST(r.datetime || ':00' AS TIMESTAMP) AT TIME ZONE z.zone) AT TIME ZONE 'UTC' AS utc, TRY_CAST(r.cfs AS DOUBLE) AS cfs
FROM iv_raw r JOIN (SELECT site_no, {_ZONE} AS zone FROM iv_raw GROUP BY site_no) z USING (site_no)""",
    "flow_hourly": "SELECT site_no, ord, utc AS hour_updated, cfs FROM flow_utc WHERE substr(datetime, 15, 2) = '00'",
    "weather_january": _folded("asos_raw"),
    "weather_hourly": _folded("asos_fall"),
    # Hourly readings of three gauges: every order line reports through its day, with some hours left out.
    "hourly_iv": """SELECT l_suppkey % 3 AS site, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(h AS INT)) AS datetime,
  CASE WHEN (l_orderkey + h) % 29 <> 0 THEN CAST(l_quantity + (h * 7 + l_linenumber) % 11 AS DOUBLE) END AS cfs
FROM (SELECT *, unnest(range(0, 24)) AS h FROM lineitem) WHERE (l_partkey + h) % 17 <> 0""",
    "hours": "SELECT site, datetime AS t, avg(cfs) AS cfs FROM hourly_iv GROUP BY 1, 2",
    # Weather of site 100000nn comes from station K0nn.
    "weather_site": """SELECT lpad(CAST(10000000 + CAST(substr(station, 2) AS BIGINT) AS STRING), 8, '0') AS site_no, *
FROM weather_hourly WHERE CAST(substr(station, 2) AS BIGINT) < 12""",
    "joined": "SELECT w.*, f.ord, f.cfs FROM weather_site w JOIN flow_hourly f USING (site_no, hour_updated)",
}

# Views needed for the chains above, in order.
JOINED = ("asos_fall", "iv_raw", "flow_utc", "flow_hourly", "weather_hourly", "weather_site", "joined")
FLOW = ("iv_raw", "flow_utc", "flow_hourly")
