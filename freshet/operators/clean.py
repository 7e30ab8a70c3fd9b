"""Cleaning: renames, numbers, clocks, filters and splits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from freshet import constants as K
from freshet.functions import clock, numbers
from freshet.operators import blocks


def rename_by_param(df: DataFrame, values: str = "values") -> DataFrame:
    """Turn a map of `<series>_<parameter>` readings into cfs, height and precip_usgs text columns.

    Qualifier keys (any name with "cd") are left out; a parameter read by several series takes the one
    with the lowest series number.
    """
    def pick(code: str) -> Column:
        entries = F.filter(F.map_entries(F.col(values)),
                           lambda e: (F.get(F.split(e["key"], "_"), F.lit(1)) == code) & ~e["key"].contains("cd"))
        ordered = F.array_sort(F.transform(entries, lambda e: F.struct(
            F.split(e["key"], "_")[0].try_cast("bigint").alias("series"), e["key"].alias("key"),
            e["value"].alias("value"))))
        return F.get(ordered, F.lit(0))["value"]

    return df.withColumns({name: pick(code) for code, name in K.FLOW_PARAMETERS.items()}).drop(values)


def rename_columns_by_param(df: DataFrame) -> DataFrame:
    """The same rename for a wide table whose series are columns."""
    chosen: dict[str, tuple[int, str]] = {}
    for column in df.columns:
        parts = column.split("_")
        if len(parts) > 1 and parts[1] in K.FLOW_PARAMETERS and "cd" not in column:
            rank = int(parts[0]) if parts[0].isdigit() else 10 ** 18
            name = K.FLOW_PARAMETERS[parts[1]]
            if name not in chosen or rank < chosen[name][0]:
                chosen[name] = (rank, column)
    return df.withColumnsRenamed({column: name for name, (_, column) in chosen.items()})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numbers.to_number(F.col(c)) for c in columns if c in df.columns})


def null_fills(df: DataFrame, columns: Sequence[str], equals: float | None = None,
               at_most: float | None = None) -> DataFrame:
    return df.withColumns({c: numbers.null_fill(F.col(c), equals, at_most) for c in columns})


def local_to_utc(df: DataFrame, key: str = "site_no", local: str = "datetime", code: str = "tz_cd",
                 order: str = "ord", codes_from: DataFrame | None = None) -> DataFrame:
    """Replace the local clock text by its UTC time, using the clock code of the first row of each key.

    The first row's code is found with a map-side aggregate (over `codes_from` when `df` is only a part of the
    pull) and joined back, so a site that fills a large part of the table is never gathered in one task.
    """
    pull = df if codes_from is None else codes_from
    rank = F.unix_seconds(F.to_timestamp(F.col(order), "yyyy-MM-dd HH:mm")) if order == local else F.col(order)
    codes = pull.groupBy(key).agg(F.min_by(clock.code_number(F.col(code)), rank).alias("_code"))
    stamped = df.withColumn(local, F.to_timestamp(F.col(local), "yyyy-MM-dd HH:mm"))
    return stamped.join(codes, key).withColumn(local, clock.code_to_utc(F.col(local), F.col("_code"), F.col(key))).drop("_code")


def top_of_local_hour(df: DataFrame, local: str = "datetime") -> DataFrame:
    """Rows whose clock text shows a full hour. All zones are whole hours off, so UTC agrees."""
    return df.filter(F.col(local).endswith(":00"))


def top_of_hour(df: DataFrame, ts: str = "datetime") -> DataFrame:
    return df.filter(F.minute(ts) == 0)


def drop_quality_codes(df: DataFrame, also: Sequence[str] = ("site_no",)) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in also and not c.endswith("_cd")])


def season_days(df: DataFrame, start: str, end: str, name: str = "day") -> DataFrame:
    """Every snow-season date of each row's closed period."""
    days = df.withColumn(name, F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))))
    return days.filter(clock.in_snow_season(F.col(name)))


def time_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Closed interval; comparing the bare column lets the scan skip row groups."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def image_range_or_day(df: DataFrame, ts: str, day: str | date | None = None, start: str | None = None,
                       end: str | None = None) -> DataFrame:
    """One calendar day if given, otherwise the closed range."""
    if day is not None:
        begin = F.lit(str(day)).cast("date").cast("timestamp")
        return df.filter((F.col(ts) >= begin) & (F.col(ts) < begin + F.expr("INTERVAL '1' DAY")))
    return time_range(df, ts, start, end)


def cloud_filter(df: DataFrame, max_cloud_percent: float | None = None,
                 min_valid_fraction: float = 0.05) -> DataFrame:
    kept = df.filter(F.col("valid_fraction") >= min_valid_fraction)
    return kept if max_cloud_percent is None else kept.filter(F.col("cloud_percent") <= max_cloud_percent)


def station_record_floor(df: DataFrame, distance: Column, record: Column, name: str = "snotel",
                         max_km: float = K.SNOTEL_MAX_KM) -> DataFrame:
    """Attach the station record only within the distance limit."""
    return df.withColumn(name, F.when(distance <= max_km, record))


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def tile_filter(df: DataFrame, tiles: str | Sequence[str], column: str = "tile") -> DataFrame:
    names = [tiles] if isinstance(tiles, str) else list(tiles)
    return df.filter(F.col(column).isin(names))


def calendar_split(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column,
                   bands: dict[str, tuple[int, int]], ts: str | None = None,
                   cutoff: str | None = None) -> DataFrame:
    """Label rows by zero-based position bands `[start, end)` after sorting; rows outside get null.

    With a cutoff, rows at or after it are removed first.
    """
    if cutoff is not None:
        df = df.filter(F.col(ts) < F.lit(cutoff).cast(df.schema[ts].dataType))
    placed = blocks.with_position(df, keys, order, block)
    label = F.lit(None).cast("string")
    for name, (start, end) in reversed(list(bands.items())):
        inside = (F.col("position") > start) & (F.col("position") <= end)
        label = F.when(inside, F.lit(name)).otherwise(label)
    return placed.withColumn("split", label)


def snow_states(df: DataFrame, state: str = "state") -> DataFrame:
    return df.filter(F.col(state).isin(K.SNOW_STATES))
