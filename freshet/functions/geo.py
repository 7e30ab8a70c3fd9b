"""Distances, map tiles, terrain pixels and elevation bands."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F

from freshet.constants import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    half_lat = F.radians(lat2 - lat1) / F.lit(2.0)
    half_lon = F.radians(lon2 - lon1) / F.lit(2.0)
    h = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2.0)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def tile_x(lon: Column, zoom: int) -> Column:
    n = 2 ** zoom
    raw = ((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(n))).cast("bigint")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))


def tile_y(lat: Column, zoom: int) -> Column:
    n = 2 ** zoom
    angle = F.asinh(F.tan(F.radians(lat)))
    raw = ((F.lit(1.0) - angle / F.pi()) / F.lit(2.0) * F.lit(float(n))).cast("bigint")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))


def terrain_elevation(red: Column, green: Column, blue: Column) -> Column:
    """Metres encoded in a terrain pixel."""
    return red * F.lit(256.0) + green + blue / F.lit(256.0) - F.lit(32768.0)


def pixel_lon(column: Column, zoom: int, tile_size: int = 256) -> Column:
    """Longitude of a pixel centre, counted from the map's west edge."""
    return (column + F.lit(0.5)) / F.lit(float(2 ** zoom * tile_size)) * F.lit(360.0) - F.lit(180.0)


def pixel_lat(row: Column, zoom: int, tile_size: int = 256) -> Column:
    """Latitude of a pixel centre, counted from the map's north edge."""
    share = (row + F.lit(0.5)) / F.lit(float(2 ** zoom * tile_size))
    return F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - F.lit(2.0) * share))))


def band_quantiles(n_bands: int) -> list[float]:
    """Standard normal quantiles at the middle of each equal-area band."""
    normal = NormalDist()
    return [normal.inv_cdf((i + 0.5) / n_bands) for i in range(n_bands)]


def equal_area_bands(mean_m: Column, std_m: Column, n_bands: int = 5) -> Column:
    """Band elevations of a basin whose heights are taken as normally distributed."""
    spread = F.greatest(std_m, F.lit(1.0))
    return F.array(*[mean_m + spread * F.lit(z) for z in band_quantiles(n_bands)])


def band_edges(bands: Column) -> Column:
    """Midpoints between neighbouring band elevations, which must ascend."""
    pairs = F.zip_with(F.slice(bands, F.lit(1), F.size(bands) - 1), F.slice(bands, F.lit(2), F.size(bands) - 1),
                       lambda a, b: F.when(b > a, (a + b) / F.lit(2.0)).otherwise(
                           F.raise_error(F.lit("band elevations must be strictly ascending")).cast("double")))
    return F.when(F.size(bands) > 1, pairs).otherwise(F.array().cast("array<double>"))


def band_index(elevation: Column, bands: Column) -> Column:
    """Zero-based band: the number of edges at or below the elevation."""
    return F.size(F.filter(band_edges(bands), lambda e: elevation >= e))
