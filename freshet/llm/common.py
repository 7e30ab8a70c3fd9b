"""Helpers shared by the text operators: tables, stored intermediate results, names and ASCII text rules."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.session import scratch_dir

#: Fixed character sets of the text rules.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_end(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns as one value; unpacked() gives them back after joins, whatever their names are."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(names: list[str], row: str = "row", replaced: set[str] | frozenset[str] = frozenset()) -> list[Column]:
    """The columns of packed(); those that a result column replaces are left out."""
    gone = {c.lower() for c in replaced}
    return [F.col(row).getField(c).alias(c) for c in names if c.lower() not in gone]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; all-ASCII texts take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def alnum_words(text: Column) -> Column:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS, -1), "")


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
