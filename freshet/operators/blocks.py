"""Ordered operators that never put a whole key into one task.

A key's rows are cut into time blocks. Each block is worked on by itself, and only one small summary row
per block is ordered along the key, so a key that holds a large share of the table is still spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = "_block"


def _offsets(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column,
                  name: str = "position") -> DataFrame:
    """One-based row number along each key. `block` must rise with `order`."""
    keys = list(keys)
    cut = df.withColumn(BLOCK, block)
    counts = _offsets(cut.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n")), keys).drop("_n")
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    numbered = cut.withColumn("_rank", F.row_number().over(inside))
    joined = _null_safe_join(numbered, counts, [*keys, BLOCK])
    return joined.withColumn(name, F.col("_offset") + F.col("_rank")).drop(BLOCK, "_rank", "_offset")


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    names = {c: f"_r_{i}" for i, c in enumerate(on)}
    right = right.withColumnsRenamed(names)
    condition = [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()]
    joined = left.join(right, condition, "inner")
    return joined.drop(*names.values())


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column,
                    value: str) -> DataFrame:
    """Add the nearest non-null values before and after each row (itself included) and their row positions.

    New columns: position, before_value, before_position, after_value, after_position.
    """
    keys = list(keys)
    cut = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("_rank").alias("p")))
    ranked = cut.withColumn("_rank", F.row_number().over(inside)).withColumn("_seen", seen)
    summary = _offsets(
        ranked.groupBy(*keys, BLOCK).agg(
            F.count(F.lit(1)).alias("_n"),
            F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("_rank"))).alias("_last"),
            F.min_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("_rank"))).alias("_first"),
        ), keys)
    shifted = [F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.v").alias("v"),
                                                      (F.col(f"{c}.p") + F.col("_offset")).alias("p"))).alias(c)
               for c in ("_last", "_first")]
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = summary.select(*keys, BLOCK, "_offset", *shifted).select(
        *keys, BLOCK, "_offset",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_out"))
    # Running backwards, because a frame up to the end would be read again for every row.
    backwards = Window.partitionBy(*keys, BLOCK).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _null_safe_join(
        ranked.withColumn("_b", F.last("_seen", ignorenulls=True).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_a", F.last("_seen", ignorenulls=True).over(backwards)),
        carried, [*keys, BLOCK])
    return joined.select(
        *df.columns,
        (F.col("_offset") + F.col("_rank")).alias("position"),
        F.coalesce("_b.v", "_in.v").alias("before_value"),
        F.coalesce(F.col("_b.p") + F.col("_offset"), F.col("_in.p")).alias("before_position"),
        F.coalesce("_a.v", "_out.v").alias("after_value"),
        F.coalesce(F.col("_a.p") + F.col("_offset"), F.col("_out.p")).alias("after_position"))


def ends(df: DataFrame, keys: Sequence[str], order: Column, count: int) -> DataFrame:
    """Per key, the `count`-th smallest and largest order value (null when a key has fewer rows).

    Ranking with a limit lets Spark drop all other rows before the shuffle.
    """
    keys = list(keys)
    ordered = df.select(*keys, order.alias("_o"))

    def edge(direction: Column, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(direction))
        return (ordered.withColumn("_k", rank).filter(F.col("_k") <= count)
                .groupBy(*keys).agg(F.max(F.when(F.col("_k") == count, F.col("_o"))).alias(name)))

    low = edge(F.col("_o").asc(), "low_edge")
    return low.join(edge(F.col("_o").desc(), "high_edge"), keys, "full")
