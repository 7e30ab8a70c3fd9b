"""Files named by their day as Spark data sources: days are chosen by file name before anything is read.

`snow_archive` gives the cells of daily snow archives, `day_map` the texts of daily `{site: mean}` maps. The options
start and end (days, both included) reach the listing: files whose name says another day get no partition, and files
without a day in their name always count. An archive is a partition of its own, small texts share one. Folders are
listed with Arrow's file systems (local, HDFS, object stores); the list has a row per file.

The days are options and no pushed filters, because Spark 4.1 keeps what was pushed for one query on a data frame for
the next one on it.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def day_of(name: str) -> datetime.date | None:
    """The first eight digits of a file's name that are a day."""
    for digits in re.findall(r"(?<!\d)\d{8}(?!\d)", name.rsplit("/", 1)[-1]):
        try:
            return datetime.datetime.strptime(digits, "%Y%m%d").date()
        except ValueError:
            continue
    return None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class DatedReader(DataSourceReader):
    """Partitions of the files that end in `endings` and lie in the days asked for; files without a day always count."""

    endings: tuple[str, ...] = ()
    at_once = 1  # files of a partition

    def __init__(self, options: dict):
        self.folder, self.options = options["path"], dict(options)
        self.days = [datetime.date.fromisoformat(options[x]) if options.get(x) else None for x in ("start", "end")]

    def wanted(self, path: str) -> bool:
        day, (start, end) = day_of(path), self.days
        return day is None or (start is None or day >= start) and (end is None or day <= end)

    def partitions(self) -> list[Files]:
        system, base = file_system(self.folder)
        given = system.get_file_info(base)
        found = [given] if given.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(self.endings)
                       and not f.base_name.startswith((".", "_")))
        chosen = [p for p in paths if self.wanted(p)]
        return [Files(chosen[i:i + self.at_once]) for i in range(0, len(chosen), self.at_once)]

    def contents(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        system = file_system(self.folder)[0]
        for path in partition.paths if partition is not None else ():  # Spark calls once where no file is left
            with system.open_input_stream(path, compression=None) as stream:
                yield path, stream.read()


class SnowArchiveReader(DatedReader):
    endings = (".tar",)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from freshet import constants as K
        from freshet.sources.grids import cell_batches

        box = self.options.get("box")
        for _, content in self.contents(partition):
            yield from cell_batches(content, self.options.get("product", K.SNOW_PRODUCT), json.loads(box) if box else None)


class SnowArchive(DataSource):
    """Options: start, end, product (of the archive's members), box (JSON list: min_lon, min_lat, max_lon, max_lat)."""

    @classmethod
    def name(cls) -> str:
        return "snow_archive"

    def schema(self) -> str:
        from freshet.sources.grids import CELL_SCHEMA

        return CELL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SnowArchiveReader(self.options)


class DayMapReader(DatedReader):
    endings = (".json",)
    at_once = 128  # small texts

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, content in self.contents(partition):
            yield path.rsplit("/", 1)[-1], day_of(path), content.decode("utf-8")


class DayMap(DataSource):
    @classmethod
    def name(cls) -> str:
        return "day_map"

    def schema(self) -> str:
        return "file string, day date, value string"

    def reader(self, schema) -> DataSourceReader:
        return DayMapReader(self.options)


def load(spark: SparkSession, kind: type[DataSource], folder: str, **options: str | None) -> DataFrame:
    """The source's rows; options without a value are left out."""
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(**{k: v for k, v in options.items() if v is not None}).load(folder)
