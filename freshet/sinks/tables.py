"""Writers for series, records, outlines, manifests and the progress registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SITE_BUCKETS = 64


def site_bucket(site: Column, buckets: int = SITE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(buckets)).cast("int")


def write_hourly(df: DataFrame, path: str, key: str = "site_no", ts: str = "hour_updated", mode: str = "append",
                 partitions: Sequence[str] = ("state",), fmt: str = "parquet") -> None:
    """Hourly rows in folders of state and site bucket.

    Rows are gathered by folder and then rebalanced by size: a site with very many rows is split over several
    tasks and files, small folders share a task. Inside a file rows lie by site and time, so scans can skip by
    statistics.
    """
    folders = [*[p for p in partitions if p in df.columns], "site_bucket"]
    placed = df.withColumn("site_bucket", site_bucket(F.col(key)))
    ranged = placed.hint("rebalance", *folders).sortWithinPartitions(*folders, key, ts)
    writer = ranged.write.mode(mode).partitionBy(*folders)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_static(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "json") -> None:
    """One record per gauge."""
    df.write.mode(mode).format(fmt).save(path)


def basin_feature(polygons: Column, site: Column) -> Column:
    """GeoJSON Feature text of a basin."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates")).alias("geometry"),
        F.struct(site.alias("site_no")).alias("properties")))


def write_basins(df: DataFrame, path: str, key: str = "site_no", mode: str = "overwrite") -> None:
    df.select(basin_feature(F.col("polygons"), F.col(key)).alias("value")).write.mode(mode).text(path)


def write_series(df: DataFrame, path: str, key: str = "site_no", ts: str = "datetime", mode: str = "overwrite") -> None:
    """One folder per basin, rows in time order; a basin with very many rows is split by size."""
    df.hint("rebalance", key).sortWithinPartitions(key, ts).write.mode(mode).partitionBy(key).parquet(path)


def write_manifest(df: DataFrame, path: str, mode: str = "append", fmt: str = "csv") -> None:
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_warehouse(df: DataFrame, table: str, path: str | None = None) -> None:
    """Append to a named table (created on first use)."""
    writer = df.write.mode("append").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_panels(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Panel records with their slices as an array of structs."""
    df.write.mode(mode).parquet(path)


REGISTRY_SCHEMA = ("site_no string, status string, rows bigint, error string, finished_at timestamp")


def write_registry(df: DataFrame, path: str) -> None:
    """Append status rows; readers keep the latest per site, so a lost writer never harms older state."""
    df.write.mode("append").parquet(path)


def latest_per_key(df: DataFrame, key: str = "site_no", order: str = "finished_at") -> DataFrame:
    """Latest row of each key; equal times are decided by the row's other values."""
    rest = [c for c in df.columns if c != key]
    last = F.max(F.struct(F.col(order).alias("_at"), F.struct(*rest).alias("_row")))
    return df.groupBy(key).agg(last.alias("_r")).select(key, "_r._row.*")


def read_registry(spark: SparkSession, path: str, schema: str = REGISTRY_SCHEMA) -> DataFrame:
    """Latest status per site; empty when nothing was written yet."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return latest_per_key(rows)


def write_files(files: DataFrame, folder: str) -> None:
    """One file per row (name, content) below a folder that all executors reach.

    A file appears under its name when it is whole; a repeated task writes the same file again.
    """
    def put(rows) -> None:
        import uuid

        from freshet.sources.dated import file_system

        system, base = file_system(folder)
        for row in rows:
            place = f"{base.rstrip('/')}/{row['name']}"
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            part = f"{place.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(bytes(row["content"]))
            system.move(part, place)

    files.select("name", "content").foreachPartition(put)
