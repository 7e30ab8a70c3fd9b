"""Snow over basins: daily means, elevation bands and the state estimated from stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.functions import geo, numbers
from freshet.operators import rollups, spatial


def basin_swe_series(cells: DataFrame, mask: DataFrame, key: str = "site_no", name: str = "snodas_swe_mm",
                     value: str = "swe_mm") -> DataFrame:
    """Daily mean snow of each basin; the mask is made once per grid and reused for every day."""
    return spatial.basin_mean(cells, mask, [key], ["date"], value).select(
        key, F.col("date").alias("datetime"), F.col(f"mean_{value}").alias(name))


def basin_swe_bands(cells: DataFrame, basins: DataFrame, dem: DataFrame, bands: DataFrame, dem_step: float,
                    key: str = "site_no") -> DataFrame:
    """Snow grid, basin outlines and terrain to band means."""
    mask = spatial.polygon_join(cells, basins, key)
    heights = spatial.dem_sample_nn(cells, dem, dem_step)
    return spatial.band_means(heights, mask, bands, key)


def sample_basin_snotel(boxes: DataFrame, stations: DataFrame, readings: DataFrame, day: str,
                        key: str = "site_no", digits: int | None = None) -> DataFrame:
    """Snow of every station inside each basin's box on one date, in millimetres and metres, rounded if `digits` is given.

    Stations carry elevation in feet; readings carry WTEQ in inches. Stations without a reading are dropped. Readings
    join the stations first and are converted there, as stations are far fewer than the pairs of basin and station.
    """
    wanted = readings.filter(F.col("date") == F.lit(day).cast("date")).filter(F.col("WTEQ").isNotNull())
    values = {"elevation_m": numbers.feet_to_m(F.col("elevation")), "swe_mm": numbers.inches_to_mm(F.col("WTEQ"))}
    reporting = stations.select("station_id", "lat", "lon", "elevation").join(
        wanted.select("station_id", "WTEQ").hint("merge"), "station_id").select("station_id", "lat", "lon", *[
            (v if digits is None else F.round(v, digits)).alias(c) for c, v in values.items()])
    joined = spatial.bbox_join(reporting, boxes.select(key, "min_lon", "min_lat", "max_lon", "max_lat"))
    return joined.select(key, "station_id", *values)


def snow_state(basins: DataFrame, samples: DataFrame, n_bands: int = 5, key: str = "site_no",
               mean: str = "elev_mean_m", std: str = "elev_std_m") -> DataFrame:
    """Band snow and basin mean from the basin's height distribution and its station samples.

    Basins without a sample hold no snow.
    """
    banded = basins.withColumn("bands", geo.equal_area_bands(F.col(mean), F.col(std), n_bands))
    fitted = banded.join(rollups.snow_profile_fit(samples, [key]), key, "left")
    return rollups.band_swe_estimate(fitted)
