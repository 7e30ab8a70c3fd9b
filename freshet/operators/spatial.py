"""Boxes, polygons, masks, snow means and elevation bands.

A basin is one row with `polygons`: ARRAY<polygon> of ARRAY<ring> of ARRAY<[lon, lat]>; the first ring of a
polygon is its outline, the others are holes. Points and basins meet on grid buckets by equality, and each
bucket carries only the polygon edges that its latitude band needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.geo import band_index
from freshet.operators import joins

POLYGON_TYPE = "array<array<array<array<double>>>>"


def geometry_polygons(geojson: Column) -> Column:
    """Polygons of a GeoJSON text: a bare geometry, a Feature, or a collection of exactly one Feature."""
    kind = F.get_json_object(geojson, "$.type")
    count = F.json_array_length(F.get_json_object(geojson, "$.features"))
    feature = F.when(kind == "FeatureCollection", F.when(count == 1, F.get_json_object(geojson, "$.features[0]"))
                     .otherwise(F.raise_error(F.concat(F.lit("expected exactly one feature, got "),
                                                       F.coalesce(count, F.lit(0)).cast("string"))).cast("string"))
                     ).otherwise(geojson)
    shape = F.when(F.get_json_object(feature, "$.type") == "Feature",
                   F.get_json_object(feature, "$.geometry")).otherwise(feature)
    form = F.get_json_object(shape, "$.type")
    rings = F.get_json_object(shape, "$.coordinates")
    many = F.from_json(rings, POLYGON_TYPE)
    one = F.array(F.from_json(rings, "array<array<array<double>>>"))
    return (F.when(form == "MultiPolygon", many).when(form == "Polygon", one)
            .otherwise(F.raise_error(F.concat(F.lit("unsupported geometry type: "), F.coalesce(form, F.lit("NULL"))))
                       .cast(POLYGON_TYPE)))


def bbox(polygons: Column, buffer_degrees: float = 0.0) -> Column:
    """Box around all rings as struct(min_lon, min_lat, max_lon, max_lat)."""
    points = F.flatten(F.flatten(polygons))
    lons, lats = (F.transform(points, lambda p: F.get(p, F.lit(i))) for i in (0, 1))
    pad = F.lit(float(buffer_degrees))
    return F.struct((F.array_min(lons) - pad).alias("min_lon"), (F.array_min(lats) - pad).alias("min_lat"),
                    (F.array_max(lons) + pad).alias("max_lon"), (F.array_max(lats) + pad).alias("max_lat"))


def basin_bbox(basins: DataFrame, key: str = "site_no", buffer_degrees: float = 0.05) -> DataFrame:
    return basins.select(key, F.inline(F.array(bbox(F.col("polygons"), buffer_degrees))))


def _bucket(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def bbox_join(points: DataFrame, boxes: DataFrame, size: float = 0.5) -> DataFrame:
    """Points inside boxes, bounds included, by an equality join on grid buckets.

    Boxes carry min_lon, min_lat, max_lon, max_lat; points carry lat and lon. The pairs of a full bucket are dealt over
    tasks (`joins.dealt_join`), where the boxes of a point come one after the other: points have more columns to store.
    """
    spread = boxes.withColumn("_bi", F.explode(F.sequence(_bucket(F.col("min_lat"), size), _bucket(F.col("max_lat"), size))))
    spread = spread.withColumn("_bj", F.explode(F.sequence(_bucket(F.col("min_lon"), size), _bucket(F.col("max_lon"), size))))
    placed = points.withColumns({"_bi": _bucket(F.col("lat"), size), "_bj": _bucket(F.col("lon"), size)})
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    pairs = joins.dealt_join(placed, spread, ["_bi", "_bj"]).filter(inside).drop("_bi", "_bj")
    names = [*boxes.columns, *points.columns]
    return pairs.select(*names) if len({*names}) == len(names) else pairs


def _ring_edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get(F.get(ring, i), F.lit(0)).alias("x1"), F.get(F.get(ring, i), F.lit(1)).alias("y1"),
        F.get(F.get(ring, (i + 1) % n), F.lit(0)).alias("x2"), F.get(F.get(ring, (i + 1) % n), F.lit(1)).alias("y2")))


def _odd_crossings(edges: Column, lon: Column, lat: Column) -> Column:
    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        at = e["x1"] + (lat - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
        return straddles & (lon < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def polygon_buckets(basins: DataFrame, key: str, size: float) -> DataFrame:
    """One row per basin part and grid bucket of its box, with the edges that cross the bucket's band."""
    parts = basins.select(key, F.posexplode("polygons").alias("part", "rings"))
    parts = parts.withColumns({"_box": bbox(F.array("rings")), "edges": F.transform("rings", _ring_edges)})
    bands = parts.withColumn("_bi", F.explode(F.sequence(_bucket(F.col("_box.min_lat"), size),
                                                         _bucket(F.col("_box.max_lat"), size))))
    low, high = F.col("_bi") * F.lit(size), (F.col("_bi") + 1) * F.lit(size)
    clipped = F.transform("edges", lambda ring: F.filter(ring, lambda e: (
        (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high))))
    bands = bands.withColumn("edges", clipped)
    return bands.select(key, "part", "_box", "_bi", "edges", F.explode(F.sequence(
        _bucket(F.col("_box.min_lon"), size), _bucket(F.col("_box.max_lon"), size))).alias("_bj"))


def polygon_join(points: DataFrame, basins: DataFrame, key: str = "site_no", point_key: str = "cell_id",
                 size: float = 0.25) -> DataFrame:
    """(basin, point) pairs whose point lies inside: even-odd per ring, holes cut out, parts united."""
    placed = points.select(point_key, "lat", "lon", _bucket(F.col("lat"), size).alias("_bi"),
                           _bucket(F.col("lon"), size).alias("_bj"))
    pairs = placed.hint("merge").join(polygon_buckets(basins, key, size), ["_bi", "_bj"])
    near = (F.col("lon").between(F.col("_box.min_lon"), F.col("_box.max_lon"))
            & F.col("lat").between(F.col("_box.min_lat"), F.col("_box.max_lat")))
    outline = _odd_crossings(F.get("edges", F.lit(0)), F.col("lon"), F.col("lat"))
    hole = F.exists(F.slice("edges", F.lit(2), F.size("edges")), lambda ring: _odd_crossings(ring, F.col("lon"), F.col("lat")))
    return pairs.filter(near).filter(outline & ~hole).select(key, point_key).distinct()


def empty_basins(basins: DataFrame, mask: DataFrame, key: str = "site_no") -> DataFrame:
    """Basins without any cell, which the mask leaves out."""
    return basins.select(key).join(mask, key, "left_anti")


def _masked(cells: DataFrame, mask: DataFrame, cell: str) -> DataFrame:
    """Cells of each basin, once per date.

    Spark takes the grid for as large as its file, however many days were made of it, and would send all of them to
    every task; the hint has both sides meet in a shuffle.
    """
    return mask.join(cells.hint("merge"), cell)


def basin_mean(cells: DataFrame, mask: DataFrame, keys: Sequence[str] = ("site_no",), by: Sequence[str] = (),
               value: str = "swe_mm", cell: str = "cell_id") -> DataFrame:
    """Mean of the known cells of each basin (and date); a basin without a known cell gets null."""
    return _masked(cells, mask, cell).groupBy(*keys, *by).agg(F.avg(value).alias(f"mean_{value}"),
                                                           F.count(value).alias("cells"))


def basin_mean_strict(cells: DataFrame, mask: DataFrame, basins: DataFrame, key: str = "site_no",
                      value: str = "swe_mm") -> DataFrame:
    """As `basin_mean` over one grid, but a basin without a known cell fails the query."""
    means = basins.select(key).join(basin_mean(cells, mask, [key], value=value), key, "left")
    checked = F.coalesce(f"mean_{value}", F.raise_error(
        F.concat(F.lit("no valid cells inside basin "), F.col(key))).cast("double"))
    return means.withColumn(f"mean_{value}", checked)


def basin_mean_bbox(cells: DataFrame, boxes: DataFrame, key: str = "site_no", value: str = "swe_mm") -> DataFrame:
    return bbox_join(cells, boxes).groupBy(key).agg(F.avg(value).alias(f"mean_{value}"), F.count(value).alias("cells"))


def basin_mean_mask(cells: DataFrame, mask: DataFrame, key: str = "site_no", by: Sequence[str] = ("date",),
                    value: str = "swe_mm", shape: tuple[int, int] | None = None) -> DataFrame:
    """Means from a stored mask; with `shape`, grids of another number of rows or columns fail the query.

    The grid check is an aggregate per date that joins back to the date's few result rows.
    """
    means = basin_mean(cells, mask, [key], by, value)
    if shape is None:
        return means
    extent = cells.groupBy(*by).agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
    fits = (F.col("_rows") == shape[0]) & (F.col("_cols") == shape[1])
    checked = F.when(fits, F.col(f"mean_{value}")).otherwise(F.raise_error(F.concat(
        F.lit("grid shape changed: "), F.col("_rows").cast("string"), F.lit(" x "), F.col("_cols").cast("string"))).cast("double"))
    return means.join(extent, list(by)).withColumn(f"mean_{value}", checked).drop("_rows", "_cols")


def _nearest_axis(wanted: DataFrame, axis: DataFrame, size: float) -> DataFrame:
    """Nearest axis position of each wanted coordinate; the first index wins ties.

    Values beyond the axis are moved to its end first and a bucket is at least as wide as the widest gap of the axis,
    so the nearest position always lies in the value's bucket or a neighbouring one. The gaps are read off the axis
    alone, one number per grid row or column.
    """
    low, high = axis.agg(F.min("a")).scalar(), axis.agg(F.max("a")).scalar()
    gap = F.col("a") - F.lag("a").over(Window.orderBy("a"))
    widest = axis.select("a").distinct().select(gap.alias("gap")).agg(F.max("gap")).scalar()
    size = F.greatest(F.lit(float(size)), F.coalesce(widest, F.lit(0.0)))
    placed = wanted.withColumn("_c", F.least(F.greatest(F.col("v"), low), high))
    pairs = (placed.withColumn("_b", F.explode(F.array(*[_bucket(F.col("_c"), size) + d for d in (-1, 0, 1)])))
             .join(axis.withColumn("_b", _bucket(F.col("a"), size)), "_b"))
    return pairs.groupBy("v").agg(F.min_by("idx", F.struct(F.abs(F.col("v") - F.col("a")), F.col("idx"))).alias("idx"))


def dem_sample_nn(cells: DataFrame, dem: DataFrame, step: float, value: str = "elevation_m") -> DataFrame:
    """Elevation of the nearest terrain row and column of each cell, per axis.

    `step` is the usual spacing of the terrain axes; wider gaps are measured, so no cell misses its neighbour.
    """
    lat_axis = dem.groupBy("row").agg(F.first("lat").alias("a")).select(F.col("row").alias("idx"), "a")
    lon_axis = dem.groupBy("col").agg(F.first("lon").alias("a")).select(F.col("col").alias("idx"), "a")
    by_lat = _nearest_axis(cells.select(F.col("lat").alias("v")).distinct(), lat_axis, step).withColumnsRenamed(
        {"v": "lat", "idx": "_dem_row"})
    by_lon = _nearest_axis(cells.select(F.col("lon").alias("v")).distinct(), lon_axis, step).withColumnsRenamed(
        {"v": "lon", "idx": "_dem_col"})
    heights = dem.select(F.col("row").alias("_dem_row"), F.col("col").alias("_dem_col"), F.col(value))
    return (cells.join(by_lat, "lat", "left").join(by_lon, "lon", "left")
            .join(heights, ["_dem_row", "_dem_col"], "left").drop("_dem_row", "_dem_col"))


def band_means(cells: DataFrame, mask: DataFrame, bands: DataFrame, key: str = "site_no", value: str = "swe_mm",
               elevation: str = "elevation_m", cell: str = "cell_id") -> DataFrame:
    """Per basin and elevation band: known cells, their mean (null when empty) and the basin's mean.

    `bands` has one row per basin with the ascending array `bands`.
    """
    known = _masked(cells.filter(F.col(value).isNotNull()), mask, cell).join(bands, key)
    banded = (known.withColumn("band", band_index(F.col(elevation), F.col("bands")))
              .groupBy(key, "band").agg(F.sum(value).alias("_s"), F.count(value).alias("cells")))
    totals = banded.groupBy(key).agg((F.sum("_s") / F.sum("cells")).alias(f"basin_mean_{value}"))
    frame = bands.select(key, F.posexplode("bands").alias("band", "band_elevation_m"))
    return (frame.join(banded, [key, "band"], "left").join(totals, key, "left")
            .select(key, "band", "band_elevation_m", F.coalesce("cells", F.lit(0)).alias("cells"),
                    (F.col("_s") / F.col("cells")).alias(f"mean_{value}"), f"basin_mean_{value}"))
