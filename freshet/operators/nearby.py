"""Nearest and best stations without comparing every gauge with every station.

Places are put into cells of the globe. The search starts from cells of 22.5 degrees, of which the globe has a fixed
number, and goes down by levels: every surviving pair of cells is divided into four by four on both sides and judged
again, so a gauge cell only ever meets the station cells that can hold its answer, a number that geometry bounds.
Exact distances decide between what remains. Places beyond 90 degrees of latitude or 360 of longitude match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.constants import EARTH_RADIUS_KM, SOIL_MAX_KM
from freshet.functions.geo import haversine_km
from freshet.session import stored

_KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180.0
# Distances compare after rounding, so that equal places tie on every engine.
DISTANCE_DIGITS = 6
WIDEST_CELL = 22.5  # 9 by 33 cells hold every place; halving it stays exact in binary
SPLIT_BITS = 2  # four by four finer cells in each cell
LEVELS = 6  # the finest cells span 0.022 degrees


def _cells(df: DataFrame, size: float, prefix: str) -> DataFrame:
    """Cell numbers of each place."""
    i, j = F.floor(F.col("lat") / F.lit(size)), F.floor(F.col("lon") / F.lit(size))
    return df.withColumns({f"{prefix}_i": i.cast("int"), f"{prefix}_j": j.cast("int")})


def _lifted(prefix: str, levels: int, to: str) -> list[Column]:
    """Numbers of the cells that lie `levels` above."""
    return [F.shiftright(f"{prefix}_{c}", SPLIT_BITS * levels).alias(f"{to}{c}") for c in "ij"]


def _centre(index: Column, size: float) -> Column:
    return (index.cast("double") + F.lit(0.5)) * F.lit(size)


def _cell_radius(index: Column, size: float) -> Column:
    """Distance from a cell's centre that no point of it exceeds; cells are widest at the edge towards the equator."""
    edge = F.greatest(F.lit(0.0), F.abs(_centre(index, size)) - F.lit(size / 2.0))
    half = size / 2.0 * _KM_PER_DEGREE * 1.001  # the surface is curved
    return F.lit(half) * F.sqrt(F.lit(1.0) + F.pow(F.cos(F.radians(edge)), 2.0)) + F.lit(0.001)


def _between_centres(size: float) -> Column:
    return haversine_km(*[_centre(F.col(c), size) for c in ("g_i", "g_j", "s_i", "s_j")])


def _prune(pairs: DataFrame, k: int, on: Sequence[str], size: float) -> DataFrame:
    """Keep the pairs of cells whose station cell, holding `n`, may hold one of the k nearest of the gauge cell.

    Going by farthest possible distance, the first cells that together hold k stations give a distance within
    which k are certain; a cell whose nearest possible point is farther cannot matter.
    """
    reach = _cell_radius(F.col("g_i"), size) + _cell_radius(F.col("s_i"), size)
    spread = pairs.withColumn("_d", _between_centres(size)).withColumns({"_up": F.col("_d") + reach, "_lo": F.col("_d") - reach})
    cell = Window.partitionBy(*on, "g_i", "g_j")
    before = F.sum("n").over(cell.orderBy("_up", "s_i", "s_j").rowsBetween(Window.unboundedPreceding, -1))
    counted = spread.withColumn("_before", F.coalesce(before, F.lit(0)))
    certain = F.max(F.when(F.col("_before") < k, F.col("_up"))).over(cell)
    total = F.sum("n").over(cell)
    return (counted.withColumn("_enough", F.when(total >= k, certain))
            .filter(F.col("_enough").isNull() | (F.col("_lo") <= F.col("_enough"))).select(*on, "g_i", "g_j", "s_i", "s_j"))


def candidate_cells(gauges: DataFrame, stations: DataFrame, k: int, on: Sequence[str],
                    levels: int = LEVELS) -> tuple[DataFrame, float]:
    """Pairs of gauge cell and station cell that may hold one of the k nearest stations, and their cell size.

    Each side is reduced to its finest cells once, in the shared folder; coarser ones are read off their numbers.
    """
    on, fine = list(on), WIDEST_CELL / 2 ** (SPLIT_BITS * (levels - 1))
    counted = stored(_cells(stations, fine, "s").groupBy(*on, "s_i", "s_j").agg(F.count(F.lit(1)).alias("n")), "station_cells")
    asking = stored(_cells(gauges, fine, "g").select(*on, "g_i", "g_j").distinct(), "gauge_cells")

    def station_cells(up: int) -> DataFrame:
        keys = [*on, *_lifted("s", up + 1, "s_p"), *_lifted("s", up, "s_")]
        return counted.groupBy(*keys).agg(F.sum("n").alias("n"))

    def gauge_cells(up: int) -> DataFrame:
        return asking.select(*on, *_lifted("g", up + 1, "g_p"), *_lifted("g", up, "g_")).distinct()

    # Every gauge cell asks each of the fixed number of widest cells; those without stations drop out.
    rows, columns = (F.sequence(F.lit(-n), F.lit(n)) for n in (int(90 / WIDEST_CELL), int(360 / WIDEST_CELL)))
    asked = (gauge_cells(levels - 1).select(*on, "g_i", "g_j", F.explode(rows).alias("s_i"))
             .withColumn("s_j", F.explode(columns)))
    first = asked.join(station_cells(levels - 1), [*on, "s_i", "s_j"])
    pairs = _prune(first.select(*on, "g_i", "g_j", "s_i", "s_j", "n"), k, on, WIDEST_CELL)
    for up in range(levels - 2, -1, -1):
        above = {"g_i": "g_pi", "g_j": "g_pj", "s_i": "s_pi", "s_j": "s_pj"}
        both = (gauge_cells(up).join(pairs.withColumnsRenamed(above), [*on, "g_pi", "g_pj"])
                .join(station_cells(up), [*on, "s_pi", "s_pj"]))
        pairs = _prune(both.select(*on, "g_i", "g_j", "s_i", "s_j", "n"), k, on, fine * 2 ** (SPLIT_BITS * up))
    return pairs, fine


def _ranked_candidates(gauges: DataFrame, stations: DataFrame, k: int, on: Sequence[str], levels: int,
                       gauge_key: str) -> DataFrame:
    on = list(on)
    pairs, fine = candidate_cells(gauges, stations, k, on, levels)
    left = _cells(gauges.select(gauge_key, "lat", "lon", *on), fine, "g").withColumnsRenamed(
        {"lat": "g_lat", "lon": "g_lon"})
    right = _cells(stations, fine, "s")
    near = left.join(pairs, [*on, "g_i", "g_j"]).join(right, [*on, "s_i", "s_j"])
    km = F.round(haversine_km(F.col("g_lat"), F.col("g_lon"), F.col("lat"), F.col("lon")), DISTANCE_DIGITS)
    return near.withColumn("distance_km", km)


def nearest_station(gauges: DataFrame, stations: DataFrame, on: Sequence[str] = (), levels: int = LEVELS,
                    gauge_key: str = "site_no", order: str = "ord") -> DataFrame:
    """Closest station of each gauge (within the same `on` values); first in station order on ties.

    Stations at one place are first reduced to the first of them.
    """
    places = stations.groupBy(*on, "lat", "lon").agg(
        F.min_by("station_id", order).alias("station_id"), F.min(order).alias(order))
    near = _ranked_candidates(gauges, places, 1, on, levels, gauge_key)
    best = near.groupBy(gauge_key).agg(F.min_by(F.struct("station_id", "distance_km"),
                                                F.struct("distance_km", order)).alias("b"))
    return best.select(gauge_key, "b.station_id", "b.distance_km")


def k_nearest_stations(gauges: DataFrame, stations: DataFrame, k: int, on: Sequence[str] = (),
                       levels: int = LEVELS, gauge_key: str = "site_no", order: str = "ord") -> DataFrame:
    """The k closest stations of each gauge as rows with a rank.

    Of the stations at one place only the first k can be among them. Both rank limits are applied before the
    shuffle too.
    """
    here = F.row_number().over(Window.partitionBy(*on, "lat", "lon").orderBy(order))
    places = stations.withColumn("_h", here).filter(F.col("_h") <= k).drop("_h")
    near = _ranked_candidates(gauges, places, k, on, levels, gauge_key)
    rank = F.row_number().over(Window.partitionBy(gauge_key).orderBy("distance_km", order))
    return (near.select(gauge_key, "station_id", order, "distance_km").withColumn("rank", rank)
            .filter(F.col("rank") <= k).drop(order))


def station_map(ranked: DataFrame, gauge_key: str = "site_no") -> DataFrame:
    """Ranked stations of a gauge as a station-to-distance map and as an ascending array."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "station_id", "distance_km")))
    rows = ranked.groupBy(gauge_key).agg(listed.alias("stations"))
    return rows.withColumn("distances", F.map_from_entries(F.transform(
        "stations", lambda s: F.struct(s["station_id"], s["distance_km"]))))


def _cells_in_range(gauge_cells: DataFrame, reach_km: float, size: float) -> DataFrame:
    """Each gauge cell with every cell number whose centre may lie within reach, across the date line too."""
    degrees = reach_km / _KM_PER_DEGREE
    lat = _centre(F.col("g_i"), size)
    cosine = F.cos(F.radians(F.least(F.abs(lat) + F.lit(degrees + size), F.lit(89.9))))
    wide = F.least(F.lit(degrees) / cosine / F.lit(size), F.lit(180.0 / size))
    high, across = int(math.ceil(degrees / size)) + 1, F.ceil(wide).cast("int") + 1
    around, half = int(round(360.0 / size)), int(round(180.0 / size))
    js = F.array_distinct(F.transform(F.sequence(F.col("g_j") - across, F.col("g_j") + across), lambda j: (
        F.pmod(j + F.lit(half), F.lit(around)) - F.lit(half)).cast("int")))
    return (gauge_cells.withColumn("s_i", F.explode(F.sequence(F.col("g_i") - high, F.col("g_i") + high)))
            .withColumn("s_j", F.explode(js)))


def earliest_in_range(gauges: DataFrame, stations: DataFrame, max_km: float, size: float, gauge_key: str,
                      begin: str) -> DataFrame:
    """Earliest record date of any station within range of each gauge that has one.

    A station cell that lies in range as a whole settles a date by its own earliest one. Only cells on the rim
    of the range are looked into, and only for stations older than that date.
    """
    located = _cells(stations.filter(F.col(begin).isNotNull()), size, "s")
    oldest = located.groupBy("s_i", "s_j").agg(F.min(begin).alias("_oldest"))
    cells = _cells(gauges, size, "g").select("g_i", "g_j").distinct()
    widest = size * _KM_PER_DEGREE * 1.5
    reach = _cell_radius(F.col("g_i"), size) + _cell_radius(F.col("s_i"), size)
    around = (_cells_in_range(cells, max_km + widest, size).join(oldest, ["s_i", "s_j"])
              .withColumns({"_d": _between_centres(size), "_r": reach}).filter(F.col("_d") - F.col("_r") <= max_km))
    whole = F.col("_d") + F.col("_r") <= max_km
    settled = around.groupBy("g_i", "g_j").agg(F.min(F.when(whole, F.col("_oldest"))).alias("_sure"))
    rim = (around.filter(~whole).join(settled, ["g_i", "g_j"])
           .filter(F.col("_sure").isNull() | (F.col("_oldest") < F.col("_sure"))).select("g_i", "g_j", "s_i", "s_j", "_sure"))
    asking = _cells(gauges.select(gauge_key, F.col("lat"), F.col("lon")), size, "g")
    older = located.select("s_i", "s_j", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.col(begin).alias("_b")).distinct()
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")), DISTANCE_DIGITS)
    found = (asking.join(rim, ["g_i", "g_j"]).join(older, ["s_i", "s_j"])
             .filter((F.col("_sure").isNull() | (F.col("_b") < F.col("_sure"))) & (km <= max_km))
             .groupBy(gauge_key).agg(F.min("_b").alias("_rim")))
    both = asking.join(settled, ["g_i", "g_j"]).join(found, gauge_key, "left")
    return both.select(gauge_key, "lat", "lon", F.least("_sure", "_rim").alias(begin)).filter(F.col(begin).isNotNull())


def best_station(gauges: DataFrame, stations: DataFrame, max_km: float = SOIL_MAX_KM, size: float = 1.0 / 4.0,
                 gauge_key: str = "site_no", begin: str = "begin_date", order: str = "ord") -> DataFrame:
    """Station within range with the earliest record, nearest on ties; null columns when there is none.

    The earliest date in range is found first; the nearest station with just that date is then in range too. The
    dates, one row per gauge, are written to the shared folder, as every level of the search asks for them.
    """
    dated = stored(earliest_in_range(gauges, stations, max_km, size, gauge_key, begin), "dated")
    nearest = nearest_station(dated, stations, [begin], gauge_key=gauge_key, order=order)
    return (gauges.select(gauge_key).join(dated.select(gauge_key, F.col(begin).alias("element_begin")), gauge_key, "left")
            .join(nearest, gauge_key, "left").select(gauge_key, "station_id", "distance_km", "element_begin"))
