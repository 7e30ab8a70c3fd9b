"""Aggregations. All of them combine on the map side before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet import constants as K
from freshet.functions import clock, evaporation, numbers
from freshet.session import stored


def first_known(column: str, order: Column) -> Column:
    """First non-null value by an explicit order."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def hourly_weather(df: DataFrame, keys: Sequence[str] = ("station",), order: str | None = None) -> DataFrame:
    """Fold raw readings into hours: summed rain, mean temperatures, first known other values.

    An hour without any rain reading sums to 0. Optional columns are folded only when present. The order
    of readings inside an hour is `order`, or their time when it is not given; equal ones follow their values.
    """
    numeric = [*K.WEATHER_SUMMED, *K.WEATHER_AVERAGED, *K.WEATHER_FIRST_NUMERIC]
    present = [c for c in numeric if c in df.columns]
    stamp = F.to_timestamp("valid", "yyyy-MM-dd HH:mm")
    clean = df.withColumns({**{c: numbers.to_number(F.col(c)) for c in present},
                            "hour_updated": clock.ceil_to_hour(stamp)})
    folds = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in K.WEATHER_SUMMED if c in present]
    folds += [F.avg(c).alias(c) for c in K.WEATHER_AVERAGED if c in present]
    others = [c for c in [*K.WEATHER_FIRST_NUMERIC, *K.WEATHER_FIRST_TEXT] if c in df.columns]
    rank = F.col(order) if order else F.struct("valid", *[c for c in present if c not in others], *others)
    folds += [first_known(c, rank).alias(c) for c in others]
    return clean.groupBy(*keys, "hour_updated").agg(F.min_by("valid", rank).alias("valid"), *folds)


def missing_marks(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count the literal mark M per column; a trace T is not missing."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c) == "M").alias(f"missing_{c}") for c in columns])


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column in one pass, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "missing")


def flow_stats(df: DataFrame, keys: Sequence[str] = ("site_no",), flow: str = "cfs") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(flow).alias("max_flow"), F.min(flow).alias("min_flow"),
                                 F.count_if(F.col(flow).isNull()).alias("nan_flow"))


def join_quality(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"),
                                 F.count_if(F.col("p01m").isNull()).alias("nan_precip"),
                                 F.count_if(F.col("cfs").isNull()).alias("nan_flow"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def hourly_mean(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Mean per observed hour (null readings do not count)."""
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(F.avg(value).alias(value))


def images_per_hour(df: DataFrame, keys: Sequence[str], ts: str, path: str) -> DataFrame:
    """Image paths of each rounded hour in time order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(path).alias("p"))))
    return (df.groupBy(*keys, clock.round_to_hour(F.col(ts)).alias("hour_updated"))
            .agg(F.transform(listed, lambda x: x["p"]).alias("image_path")))


def period_of_record(df: DataFrame, key: str = "site_no", order: str = "ord") -> DataFrame:
    """Earliest series per `<type>_<parameter>`, with its end and count; the first listed on ties."""
    entry = F.struct("begin_date", "end_date", "count_nu")
    series = df.filter(F.length("parm_cd") > 0).withColumn("series", F.concat_ws("_", "data_type_cd", "parm_cd"))
    best = series.groupBy(key, "series").agg(F.min_by(entry, F.struct("begin_date", order)).alias("e"))
    return best.select(key, "series", "e.begin_date", "e.end_date", F.col("e.count_nu").alias("count"))


def element_begin(df: DataFrame, key: str = "triplet", element: str = "SMS",
                  duration: str | None = "HOURLY") -> DataFrame:
    """Earliest sensor date of an element, preferring one duration when the station has it at all."""
    own = df.filter(F.col("element_code") == element)
    begin = F.when(F.length("begin_date") > 0, F.substring("begin_date", 1, 10))
    if duration is None:
        return own.groupBy(key).agg(F.min(begin).alias("element_begin"))
    hit = F.col("duration") == duration
    return (own.groupBy(key)
            .agg(F.coalesce(F.max(hit), F.lit(False)).alias("has"), F.min(F.when(hit, begin)).alias("b1"),
                 F.min(begin).alias("b2"))
            .select(key, F.when(F.col("has"), F.col("b1")).otherwise(F.col("b2")).alias("element_begin")))


def data_availability(gauges: DataFrame, key: str = "site_no") -> DataFrame:
    """First date on which all tabular sources, and then images too, are present.

    Expects ISO date columns usgs_hourly_begin, asos_begin, scan_begin, nldas_begin and sentinel_begin.
    """
    tabular = ["usgs_hourly_begin", "asos_begin", "scan_begin", "nldas_begin"]
    complete = F.lit(True)
    for c in tabular:
        complete = complete & F.col(c).isNotNull()
    table = gauges.withColumn("aligned_tabular_begin", F.when(complete, F.greatest(*tabular)))
    both = F.col("aligned_tabular_begin").isNotNull() & F.col("sentinel_begin").isNotNull()
    return table.withColumn("aligned_multimodal_begin",
                            F.when(both, F.greatest("aligned_tabular_begin", "sentinel_begin")))


def snow_profile_fit(df: DataFrame, keys: Sequence[str], elevation: str = "elevation_m",
                     swe: str = "swe_mm") -> DataFrame:
    """Snow line and slope of snow against height, per key.

    The line lies between the highest dry and the lowest snowy site; the slope is least squares through it.
    Keys without a snowy site get slope 0. The lines, one row per key, are written to the shared folder: their true
    size then decides whether the samples have to be shuffled to meet them.
    """
    keys = list(keys)
    z, s = F.col(elevation), F.col(swe)
    lines = df.groupBy(*keys).agg(F.max(F.when(s <= 1.0, z)).alias("dry"), F.min(F.when(s > 1.0, z)).alias("snowy"))
    middle = (F.col("dry") + F.least(F.col("snowy"), F.col("dry") + 400.0)) / F.lit(2.0)
    line = (F.when(F.col("snowy").isNull(), F.lit(0.0)).when(F.col("dry").isNull(), F.col("snowy") - 200.0)
            .when(F.col("snowy") > F.col("dry"), middle).otherwise(F.col("dry")))
    lines = stored(lines.select(*keys, line.alias("snow_line")), "snow_lines")
    above = F.greatest(z - F.col("snow_line"), F.lit(1.0))
    snowy = F.when(s > 1.0, above)
    slope = F.greatest(F.coalesce(F.sum(snowy * s) / F.sum(snowy * snowy), F.lit(0.0)), F.lit(0.0))
    return df.join(lines, keys).groupBy(*keys, "snow_line").agg(slope.alias("slope"))


def band_swe_estimate(df: DataFrame, bands: str = "bands") -> DataFrame:
    """Evaluate a fitted profile at band heights and average it over equal areas."""
    swe = F.transform(F.col(bands), lambda z: F.greatest(
        F.lit(0.0), F.coalesce(F.col("slope"), F.lit(0.0)) * (z - F.coalesce(F.col("snow_line"), F.lit(0.0)))))
    df = df.withColumn("band_swe_mm", swe)
    total = F.aggregate("band_swe_mm", F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn("basin_mean_swe_mm", total / F.size("band_swe_mm"))


def daily_pet(df: DataFrame, keys: Sequence[str], ts: str, temp: Column, latitude: Column) -> DataFrame:
    """Daily evaporation per key from the day's lowest, highest and mean temperature in Celsius."""
    days = (df.groupBy(*keys, F.to_date(ts).alias("day"), latitude.alias("latitude"))
            .agg(F.min(temp).alias("tmin"), F.max(temp).alias("tmax"), F.avg(temp).alias("tmean")))
    doy = F.dayofyear("day").cast("double")
    return days.withColumn("pet_mm_day", evaporation.hargreaves_pet(
        F.col("tmin"), F.col("tmax"), F.col("latitude"), doy, F.col("tmean")))


def hourly_pet(df: DataFrame, keys: Sequence[str], ts: str, temp: Column, latitude: Column,
               distribution: str = "daylight") -> DataFrame:
    """Spread each day's evaporation over the hours of the input rows."""
    if distribution not in ("daylight", "uniform"):
        raise ValueError(f"distribution must be 'daylight' or 'uniform', not {distribution!r}")
    doy = F.dayofyear("day").cast("double")
    weights = (evaporation.daylight_weights(F.col("latitude"), doy) if distribution == "daylight"
               else evaporation.uniform_weights())
    # The 24 shares are built once per day, not once per row.
    days = daily_pet(df, keys, ts, temp, latitude).select(*keys, "day", "pet_mm_day", weights.alias("_w"))
    return (df.withColumn("day", F.to_date(ts)).join(days, [*keys, "day"], "left")
            .withColumn("pet_mm_hr", F.col("pet_mm_day") * F.get("_w", F.hour(ts))).drop("day", "_w", "pet_mm_day"))


def valid_fraction(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Share of pixels with any band above zero."""
    lit = F.greatest(*[F.coalesce(F.col(b), F.lit(0)) for b in bands]) > 0
    return pixels.groupBy(*keys).agg(F.avg(F.when(lit, 1.0).otherwise(0.0)).alias("valid_fraction"))


def run_summary(log: DataFrame, keys: Sequence[str] = ("site_no",)) -> DataFrame:
    """Chunks fetched, skipped and failed, and combined rows, per site."""
    def status(name: str) -> Column:
        return F.count_if(F.col("status") == name)

    return log.groupBy(*keys).agg(status("fetched").alias("chunks_fetched"), status("skipped").alias("chunks_skipped"),
                                  status("failed").alias("chunk_failures"),
                                  F.coalesce(F.sum(F.when(F.col("status") != "failed", F.col("rows"))),
                                             F.lit(0)).alias("combined_rows"))


def sync_summary(listing: DataFrame) -> DataFrame:
    """Totals of a copy plan with columns `action` (upload or skip) and `size`."""
    up = F.col("action") == "upload"
    return listing.agg(F.count_if(up).alias("uploaded"), F.count_if(~up).alias("skipped"),
                       F.coalesce(F.sum(F.when(up, F.col("size"))), F.lit(0)).alias("bytes_uploaded"))


def preferred_variant(files: DataFrame, day: str = "day", variant: str = "variant") -> DataFrame:
    """Most final file variant that exists for each day."""
    rank = F.array_position(F.lit(K.SNOW_VARIANTS), F.col(variant))
    best = files.groupBy(day).agg(F.min(F.when(rank > 0, rank)).cast("int").alias("_k"))
    return best.select(day, F.get(F.lit(K.SNOW_VARIANTS), F.col("_k") - 1).alias(variant))
