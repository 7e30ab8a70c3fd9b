"""Snow archives, daily maps, basin outlines and terrain tiles."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet import constants as K
from freshet.functions import geo
from freshet.operators.spatial import geometry_polygons
from freshet.sources import dated

Paths = str | Sequence[str]


def _paths(paths: Paths) -> str | list[str]:
    return paths if isinstance(paths, str) else list(paths)


def parse_header(text: str) -> dict[str, str]:
    """`key: value` lines of a grid header."""
    pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line)
    return {key.strip(): value.strip() for key, value in pairs}


def _members(content: bytes, product: str) -> tuple[bytes, bytes]:
    """Data and header bytes of one product in a daily archive."""
    found: dict[str, bytes] = {}
    with tarfile.open(fileobj=io.BytesIO(content)) as archive:
        for member in archive:
            for kind in ("dat", "txt"):
                if f"ssmv1{product}" in member.name and member.name.endswith((f".{kind}", f".{kind}.gz")):
                    raw = archive.extractfile(member).read()
                    found.setdefault(kind, gzip.decompress(raw) if member.name.endswith(".gz") else raw)
    if len(found) < 2:
        raise KeyError(f"no data and header member of product {product}")
    return found["dat"], found["txt"]


def _day_cells(content: bytes, product: str) -> Iterator[pd.DataFrame]:
    """Known cells of one day, some grid rows at a time."""
    data, header_bytes = _members(content, product)
    header = parse_header(header_bytes.decode("ascii", errors="replace"))
    rows, cols = int(header["Number of rows"]), int(header["Number of columns"])
    grid = np.frombuffer(data, dtype=">i2").reshape(rows, cols)
    slope, offset = float(header.get("Data slope", 1.0)), float(header.get("Data intercept", 0.0))
    lon = float(header["Benchmark x-axis coordinate"]) + np.arange(cols) * float(header["X-axis resolution"])
    lat = float(header["Benchmark y-axis coordinate"]) - np.arange(rows) * float(header["Y-axis resolution"])
    day = pd.Timestamp(int(header["Start year"]), int(header["Start month"]), int(header["Start day"])).date()
    step = max(1, 200_000 // cols)
    for top in range(0, rows, step):
        part = grid[top:top + step].astype(np.float64)
        r, c = np.indices(part.shape)
        flat = part.ravel()
        yield pd.DataFrame({
            "date": day, "cell_id": ((r + top) * cols + c).ravel(), "row": (r + top).ravel(), "col": c.ravel(),
            "lat": lat[(r + top).ravel()], "lon": lon[c.ravel()],
            "swe_mm": np.where(flat == K.SNOW_FILL, np.nan, flat * slope + offset),
            "grid_rows": rows, "grid_cols": cols})


CELL_ARROW = pa.schema([("date", pa.date32()), ("cell_id", pa.int64()), ("row", pa.int32()), ("col", pa.int32()), ("lat", pa.float64()),
                        ("lon", pa.float64()), ("swe_mm", pa.float64()), ("grid_rows", pa.int32()), ("grid_cols", pa.int32())])
CELL_SCHEMA = ("date date, cell_id bigint, row int, col int, lat double, lon double, swe_mm double,"
               " grid_rows int, grid_cols int")


def archives_to_cells(archives: DataFrame, product: str = K.SNOW_PRODUCT, box: Sequence[float] | None = None) -> DataFrame:
    """Cells of archives held in a binary column `content`; fill values are null.

    One archive is one task's work, handed on some rows at a time. `box` (min_lon, min_lat, max_lon,
    max_lat) drops cells inside the task, before anything is shuffled.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for part in _day_cells(content, product):
                    if box is not None:
                        part = part[part["lon"].between(box[0], box[2]) & part["lat"].between(box[1], box[3])]
                    yield part

    cells = archives.select("content").mapInPandas(decode, CELL_SCHEMA)
    return cells.withColumn("swe_mm", F.when(~F.isnan("swe_mm"), F.col("swe_mm")))


def cell_batches(content: bytes, product: str, box: Sequence[float] | None) -> Iterator[pa.RecordBatch]:
    """The cells of one archive as Arrow batches; fill values are null."""
    for part in _day_cells(content, product):
        if box is not None:
            part = part[part["lon"].between(box[0], box[2]) & part["lat"].between(box[1], box[3])]
        yield pa.RecordBatch.from_pandas(part, schema=CELL_ARROW, preserve_index=False)


def snow_tars_to_cells(spark: SparkSession, folder: str, product: str = K.SNOW_PRODUCT, box: Sequence[float] | None = None,
                       start: str | None = None, end: str | None = None) -> DataFrame:
    """Cells of a folder's daily snow archives, one task per archive; only files named by days from `start` to `end` are
    opened."""
    return dated.load(spark, dated.SnowArchive, folder, product=product, start=start, end=end,
                      box=None if box is None else json.dumps(list(box)))


def check_grid(cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Fail the query on cells of a grid with another number of rows or columns."""
    fits = (F.col("grid_rows") == shape[0]) & (F.col("grid_cols") == shape[1])
    return cells.withColumn("cell_id", F.when(fits, F.col("cell_id")).otherwise(
        F.raise_error(F.lit("grid shape changed")).cast("bigint")))


def day_maps_to_rows(docs: DataFrame, name: str = "snodas_swe_mm") -> DataFrame:
    """Daily `{site: mean}` texts as rows; days marked missing are left out, the date comes from `file`."""
    days = docs.filter(F.col("file").endswith(".json")).filter(
        F.coalesce(F.get_json_object("value", "$.missing"), F.lit("false")) != "true")
    # The services write NaN without quotes, which JSON does not allow.
    fixed = F.regexp_replace("value", r":\s*NaN", ": null")
    rows = days.select(F.to_date(F.substring("file", 1, 8), "yyyyMMdd").alias("datetime"),
                       F.explode(F.from_json(fixed, "map<string,double>")).alias("site_no", name))
    return rows.select("site_no", "datetime", name)


def read_day_maps(spark: SparkSession, folder: str, name: str = "snodas_swe_mm", start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """Daily maps of a folder, one small file per day; only files from `start` to `end` are read."""
    docs = dated.load(spark, dated.DayMap, folder, start=start, end=end)
    return day_maps_to_rows(docs, name)


def read_basins(spark: SparkSession, paths: Paths, one_per_line: bool = False) -> DataFrame:
    """Basin outlines as multi-polygons; the site is the feature's `site_no` or the file name before `_`."""
    docs = spark.read.text(_paths(paths), wholetext=not one_per_line).select(
        F.col("_metadata.file_name").alias("file"), F.col("value"))
    site = F.coalesce(F.get_json_object("value", "$.properties.site_no"),
                      F.get_json_object("value", "$.features[0].properties.site_no"),
                      F.regexp_extract("file", r"^([^_.]+)", 1))
    return docs.select(site.alias("site_no"), geometry_polygons(F.col("value")).alias("polygons"))


def dem_tiles_to_pixels(spark: SparkSession, root: str, zoom: int, box: Sequence[float], tile_size: int = 256) -> DataFrame:
    """Terrain tiles `root/z/x/y.png` as pixels; Spark's image source decodes the PNG."""
    images = spark.read.format("image").load(f"{root.rstrip('/')}/{zoom}/*/*.png").select("image.*")
    return tiles_to_pixels(images, zoom, box, tile_size)


def tiles_to_pixels(images: DataFrame, zoom: int, box: Sequence[float], tile_size: int = 256) -> DataFrame:
    """Decoded tiles as pixels (row, col, lat, lon, elevation_m) cropped to a box.

    Pixel rows that miss the box are dropped before pixels are unpacked.
    """
    parts = F.regexp_extract("origin", r"/(\d+)/(\d+)\.png$", 1), F.regexp_extract("origin", r"/(\d+)/(\d+)\.png$", 2)
    placed = images.select("data", "nChannels", "height", "width", parts[0].cast("bigint").alias("x"),
                           parts[1].cast("bigint").alias("y"))
    row, col = F.col("y") * tile_size + F.col("r"), F.col("x") * tile_size + F.col("c")
    lines = placed.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumns(
        {"row": row, "lat": geo.pixel_lat(row, zoom, tile_size)}).filter(F.col("lat").between(box[1], box[3]))
    # One line of bytes travels with each row, not the whole tile.
    stride = F.col("width") * F.col("nChannels")
    lines = lines.select("row", "lat", "x", "width", "nChannels", F.substring(F.hex(F.substring(
        F.col("data"), F.col("r") * stride + 1, stride)), F.lit(1), stride * 2).alias("line"))
    pixels = lines.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumns(
        {"col": col, "lon": geo.pixel_lon(col, zoom, tile_size)}).filter(F.col("lon").between(box[0], box[2]))

    def channel(offset: int):
        at = (F.col("c") * F.col("nChannels") + offset) * 2 + 1
        return F.conv(F.substring(F.col("line"), at, F.lit(2)), 16, 10).cast("double")

    # Bytes come in the order blue, green, red.
    return pixels.select("row", "col", "lat", "lon",
                         geo.terrain_elevation(channel(2), channel(1), channel(0)).alias("elevation_m"))


def tile_plan(boxes: DataFrame, zoom: int = 9) -> DataFrame:
    """Tiles that cover each box (min_lon, min_lat, max_lon, max_lat)."""
    xs = F.sequence(geo.tile_x(F.col("min_lon"), zoom), geo.tile_x(F.col("max_lon"), zoom))
    ys = F.sequence(geo.tile_y(F.col("max_lat"), zoom), geo.tile_y(F.col("min_lat"), zoom))
    return boxes.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))


def combine_states(spark: SparkSession, root: str, states: Sequence[str] | None = None) -> DataFrame:
    """Records of several state folders (`root/state=XX`); only the wanted folders are listed and read."""
    records = spark.read.parquet(root)
    return records if states is None else records.filter(F.col("state").isin(list(states)))
