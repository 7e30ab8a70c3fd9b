"""Connected components by alternating large and small stars (Kiveris et al., 2014), without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the greater ones, or itself and the smaller ones) to the least of them all."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where(F.col("b") < F.col("a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        linked = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
    else:
        linked = met.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    return linked.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is the least node reachable. edges has a and b."""
    now, before = stored(edges.where(F.col("a") != F.col("b")).distinct(), "links"), None
    while True:
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_of == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = print_of
        now = stored(_stars(_stars(now, True), False), "links")
