"""Series: filling, rolling frames, de-duplication, chunks and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.operators import blocks, records
from freshet.operators.clean import season_days
from freshet.operators.joins import union_tables


def fill_nearest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, value: str,
                 name: str) -> DataFrame:
    """Value of the nearest known row by position; the earlier row wins ties, ends are extended."""
    near = blocks.with_neighbours(df, keys, order, block, value)
    back = F.col("position") - F.col("before_position")
    ahead = F.col("after_position") - F.col("position")
    pick = F.when(F.col("after_position").isNull() | (back <= ahead), F.col("before_value")).otherwise(F.col("after_value"))
    return near.withColumn(name, pick).select(*df.columns, name)


def fill_mean_of_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, value: str,
                            name: str) -> DataFrame:
    """Mean of the last known and the next known value; null when one side has none."""
    near = blocks.with_neighbours(df, keys, order, block, value)
    return near.withColumn(name, (F.col("before_value") + F.col("after_value")) / F.lit(2.0)).select(*df.columns, name)


def _frame_rows(df: DataFrame, keys: Sequence[str], index: str, value: str, width: int) -> DataFrame:
    """Every step from a key's first to its last with its value, its place in the record and its trailing frame."""
    framed = records.trailing_frames(records.record_blocks(df, keys, index, value, width), keys, width)
    rows = framed.select(*keys, records.BLOCK, "lo", "hi", F.posexplode(F.arrays_zip("values", "_n", "_s")).alias("_i", "_f"))
    step = F.col(records.BLOCK) * width + F.col("_i")
    return rows.select(*keys, step.alias(index), F.col("_f.values").alias(value), F.col("_f._n").alias("_n"), F.col("_f._s").alias("_s"),
                       (step - F.col("lo")).alias("_at"), "lo", "hi").filter(F.col(index).between(F.col("lo"), F.col("hi")))


def rolling_coverage(df: DataFrame, keys: Sequence[str], index: str, value: str, width: int) -> DataFrame:
    """Observed share of the `width` steps that end at each step of a key's record; null until the frame is full.

    Gaps of the integer index are filled in; the result has every step from a key's first to its last.
    """
    rows = _frame_rows(df, keys, index, value, width)
    return rows.select(*keys, index, value, F.when(F.col("_at") >= width - 1, F.col("_n") / F.lit(float(width))).alias("coverage"))


def rolling_log_mean(df: DataFrame, keys: Sequence[str], index: str, value: str, width: int,
                     min_observed: int) -> DataFrame:
    """Mean log flow of the trailing frame, if enough of it is observed; rounded to nine digits so that ties are exact."""
    rows = _frame_rows(df, keys, index, value, width)
    mean = records.whole_mean(F.col("_s"), F.col("_n")) / F.lit(float(records.MEAN_UNITS))
    return rows.select(*keys, index, value, F.when((F.col("_n") >= max(min_observed, 1)), mean).alias("log_mean"))


def dedupe_concat(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of chunks that keeps the first row per key in chunk order.

    A row struct goes through one map-side aggregate, so repeated keys shrink before the shuffle.
    """
    numbered = union_tables([f.withColumn("_chunk", F.lit(i)) for i, f in enumerate(frames)])
    return keep_first(numbered, keys, ["_chunk", *order]).drop("_chunk")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def calendar_chunks(periods: DataFrame, months: int, start: str = "start", end: str = "end") -> DataFrame:
    """Cut each period into abutting chunks that start on the first of a month (but for the first chunk)."""
    first = F.trunc(F.col(start), "month")
    heads = F.sequence(first, F.date_sub(F.col(end), 1), F.expr(f"INTERVAL '{int(months)}' MONTH"))
    cut = periods.filter(F.col(start) < F.col(end)).withColumn("_h", F.explode(heads))
    return (cut.withColumn("chunk_start", F.greatest(F.col("_h"), F.col(start)))
            .withColumn("chunk_end", F.least(F.add_months("_h", months), F.col(end))).drop("_h"))


def progress_by_day(periods: DataFrame, done: DataFrame, day: str = "day") -> DataFrame:
    """In-season days of each period that have no output yet."""
    return season_days(periods, "start", "end", day).join(done, day, "left_anti")
