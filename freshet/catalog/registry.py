"""Registration of queries, their input views and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.catalog.views import CTES, VIEWS
from freshet.session import configure, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass
class Inputs:
    """The given tables and the views derived from them."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")
        # The files carry zone-less times; they are UTC.
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})

    def view(self, name: str) -> DataFrame:
        source, body = VIEWS[name]
        return self.spark.sql(body.replace(f"FROM {source}", "FROM {source}"), source=self.table(source))

    def scratch(self, label: str) -> str:
        return scratch_dir(self.spark, label)


def with_ctes(names: Sequence[str], sql: str) -> str:
    """Put the named views in front of a SQL text that may bring its own."""
    parts = []
    for name in names:
        parts.append(f"{name} AS ({VIEWS[name][1] if name in VIEWS else CTES[name]})")
    text = sql.strip()
    if not parts:
        return text
    own = text[5:] if text.upper().startswith("WITH ") else None
    start = "WITH "
    if own and own.upper().startswith("RECURSIVE "):
        own, start = own[10:], "WITH RECURSIVE "
    return start + ",\n".join(parts) + (",\n" + own if own else "\n" + text)


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register a query function that takes Inputs, with its SQL text if it has one."""
    def add(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Inputs(configure(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(views, sql)
        return fn

    return add


def stamp(column: str | Column) -> Column:
    """Time as text, the same on every engine."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in columns]
