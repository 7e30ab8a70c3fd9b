"""Embedding vectors: normalising, exact neighbours, clusters and attribute vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.joins import NUMERIC_TYPES
from freshet.session import stored


def l2_normalise(df: DataFrame, vector: str = "embedding", name: str = "unit") -> DataFrame:
    """Vector divided by its length, in double; a zero vector gives null."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return df.withColumn("_n", norm).withColumn(
        name, F.when(F.col("_n") > 0.0, F.transform(F.col(vector), lambda x: x.cast("double") / F.col("_n")))).drop("_n")


# Neighbours. Unit vectors are points whose distance d follows from the cosine: d^2 = 2 - 2 cos.

#: Rings of a cell, by distance from its pivot; distances of unit vectors lie between 0 and 2.
RINGS = 32
#: Cosines are compared after rounding to nine digits; bounds of distances keep clear of that and of rounding.
ROUNDED, SLACK = 1e-9, 1e-6
#: Bytes of vectors on each side of a tile, the pairs of blocks that one call compares; a task holds both sides.
TILE_BYTES = 32 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), float)
    return values.reshape(len(column), -1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (points @ pivots.T), 0.0))


def _placed(unit: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, unit, cell, ring, far): the nearest pivot and the distance from it."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            away = _distances(_matrix(part.column(1)), pivots)
            cell = away.argmin(1)
            far = away[np.arange(len(cell)), cell]
            ring = np.minimum((far * (RINGS / 2)).astype(np.int32), RINGS - 1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(far)],
                                             names=["id", "unit", "cell", "ring", "far"])

    kind = dict(unit.dtypes)["id"]
    return unit.mapInArrow(batches, f"id {kind}, unit array<double>, cell int, ring int, far double")


def _blocks(rings: list, block_rows: int) -> list[tuple[int, int, int, int]]:
    """(cell, ring, first block, blocks) so that blocks hold about `block_rows` rows: small rings of a cell share a
    block, a large ring is dealt over several."""
    out, number, held, cell = [], 0, 0, None
    for r in rings:
        parts = -(-r["n"] // block_rows)
        if cell is not None and (r["cell"] != cell or held + r["n"] > block_rows):
            number, held = number + 1, 0
        out.append((r["cell"], r["ring"], number, parts))
        number, held, cell = number + parts - 1, block_rows if parts > 1 else held + r["n"], r["cell"]
    return out


def _top(sims: np.ndarray, own: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the k best of each row from `floor` on, by rounded similarity, then id.

    Only what may be among the k best is rounded and sorted: values below the k-th one of a row, less rounding, are not.
    """
    if np.isin(own, ids).any():
        sims[own[:, None] == ids[None, :]] = -np.inf
    floor, m = floor - 2 * ROUNDED, sims.shape[1]
    crowded = np.flatnonzero((sims >= floor[:, None]).sum(1) > k)
    if len(crowded):
        floor[crowded] = np.maximum(floor[crowded], np.partition(sims[crowded], m - k, axis=1)[:, m - k] - 2 * ROUNDED)
    row, column = np.nonzero((sims >= floor[:, None]) & np.isfinite(sims))
    sim = np.round(sims[row, column], 9)
    order = np.lexsort((ids[column], -sim, row))
    row, column, sim = row[order], column[order], sim[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k], sim[place < k]


def _near(a: np.ndarray, short: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, floor: np.ndarray,
          k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of what may be among the k best of each row from `floor` on, rounded.

    Products in single precision (`short`), whose error is bounded, choose what is reckoned in double; rows with many
    such columns are reckoned as a whole.
    """
    error, other, found = (a.shape[1] + 16) * 2.0 ** -24, b.astype(np.float32).T, []
    for at in range(0, len(a), 256):
        low = (floor[at:at + 256] - 2 * ROUNDED - error).astype(np.float32)
        hits = short[at:at + 256] @ other >= low[:, None]
        crowded = np.flatnonzero(np.count_nonzero(hits, axis=1) > max(64, 4 * k))
        if len(crowded):
            row, column, sim = _top(a[at + crowded] @ b.T, own[at + crowded], ids, floor[at + crowded], k)
            found.append((at + crowded[row], column, sim))
            hits[crowded] = False
        row, column = np.divmod(np.flatnonzero(hits), len(b))
        row += at
        sim = np.round(np.einsum("ij,ij->i", a[row], b[column]), 9)
        kept = (sim >= floor[row] - 2 * ROUNDED) & (own[row] != ids[column])
        found.append((row[kept], column[kept], sim[kept]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tile_best(left: pd.DataFrame, rights: list[tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """The k best of the right blocks (ids, vectors) for each row of a left block; what is found raises the bound for
    the blocks that follow."""
    a, own = np.stack(left["unit"].to_numpy()), left["id"].to_numpy()
    short = a.astype(np.float32)
    # Nothing below the k-th similarity of the own block, which `reach` was made of, can be among the k best.
    floor = 1.0 - left["reach"].to_numpy() ** 2 / 2.0 if "reach" in left else np.full(len(a), -2.0)
    row, name, sim = np.empty(0, int), own[:0], np.empty(0)
    for ids, b in rights:
        r, c, s = _near(a, short, own, b, ids, floor, k)
        row, name, sim = np.concatenate([row, r]), np.concatenate([name, ids[c]]), np.concatenate([sim, s])
        order = np.lexsort((name, -sim, row))
        row, name, sim = row[order], name[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, name, sim, place = row[place < k], name[place < k], sim[place < k], place[place < k]
        last = place == k - 1
        floor[row[last]] = np.maximum(floor[row[last]], sim[last])
    return pd.DataFrame({"id": own[row], "neighbour": name, "sim": sim})


def _block_best(k: int, name: str):
    """The k best of the right rows for each left row, itself left out; fewer if there are fewer, or if the row's own
    block holds nearer ones. Left rows may name the right blocks (`others`) that their block is compared with."""
    def best(rows: pd.DataFrame) -> pd.DataFrame:
        a, own, found = np.stack(rows["unit"].to_numpy()), rows["id"].to_numpy(), []
        for at in range(0, len(a), 1024):
            part = slice(at, at + 1024)
            row, column, sim = _top(a[part] @ a.T, own[part], own, np.full(len(a[part]), -2.0), k)
            found.append(pd.DataFrame({"id": own[part][row], "neighbour": own[column], "sim": sim}))
        return pd.concat(found)

    def pairs(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "sim": []})
        blocks = {n: (rows["near_id"].to_numpy(), np.stack(rows["near_unit"].to_numpy()))
                  for n, rows in (right.groupby("near") if "near" in right else [(0, right)])}
        found = [_tile_best(rows, [blocks[n] for n in (rows["others"].iloc[0] if "others" in rows else blocks) if n in blocks], k)
                 for _, rows in (left.groupby("block") if "others" in left else [(0, left)])]
        return pd.concat(found, ignore_index=True)

    def reach(rows: pd.DataFrame) -> pd.DataFrame:
        near = best(rows)
        worst = near.groupby("id")["sim"].agg(["size", "min"])
        limit = worst["min"].where(worst["size"] >= k, -1.0).reindex(rows["id"]).fillna(-1.0).to_numpy()
        return rows.assign(reach=np.sqrt(np.maximum(2.0 - 2.0 * (limit - ROUNDED), 0.0)) + SLACK)

    return reach if name == "own" else pairs


def _needs(rows: DataFrame, pivots: np.ndarray, rings: list) -> DataFrame:
    """(block, cell, ring) of the rings that may hold a match that is as near as the k-th one some row of the block has.

    A row at distance d from a ring's pivot is at least d - outer and inner - d from its points (triangle inequality),
    and at least (d^2 - e^2) / 2g from all points nearer to that pivot than to the row's own, e and g being its own
    pivot's distances from the row and from that pivot.
    """
    of = np.array([r["cell"] for r in rings])
    inner, outer = np.array([r["lo"] for r in rings]), np.array([r["hi"] for r in rings])
    number = np.array([r["ring"] for r in rings], np.int32)
    between = _distances(pivots, pivots)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The tables below have a column for each ring, so they are made for few rows at a time.
        for part in (p.slice(at, 1024) for p in parts for at in range(0, p.num_rows, 1024)):
            block, cell, far, reach = (np.asarray(part.column(i)) for i in range(1, 5))
            away = _distances(_matrix(part.column(0)), pivots)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (away ** 2 - far[:, None] ** 2) / (2 * between[cell])
            plane = np.where(between[cell] > 1e-6, plane, 0.0)
            least = np.maximum(np.maximum(away[:, of] - outer, inner - away[:, of]), plane[:, of])
            near = least <= reach[:, None]
            for b in np.unique(block):
                hit = np.flatnonzero(near[block == b].any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), b)), pa.array(of[hit].astype(np.int32)), pa.array(number[hit])],
                                                 names=["block", "cell", "ring"])

    return rows.select("unit", "block", "cell", "far", "reach").mapInArrow(batches, "block int, cell int, ring int").distinct()


def neighbour_plan(df: DataFrame, k: int = 5, key: str = "site_no", vector: str = "embedding", block_rows: int = 4096,
                   pivots: int = 256) -> tuple[DataFrame, DataFrame]:
    """Rows in blocks, and the pairs of blocks (block, other) that have to be compared for exact neighbours.

    Up to `pivots` rows serve as pivots. Every row belongs to its nearest pivot's cell and to a ring of it; rings are
    joined or dealt into blocks of about `block_rows` rows, so that a cell of equal vectors is many blocks. Each block
    is compared with itself first: the k-th similarity found is a bound, and only rings that may hold something as
    near are visited.
    """
    unit = stored(l2_normalise(df.select(F.col(key).alias("id"), vector), vector).filter(
        F.col("unit").isNotNull()).select("id", "unit"), "unit_vectors")
    # Different vectors, the first ones by hash: two for each block of rows, a fixed number at most.
    pivots = max(1, min(pivots, -(-2 * unit.count() // block_rows)))
    chosen = unit.groupBy("unit").agg(F.min(F.xxhash64("unit")).alias("h")).orderBy("h", "unit").limit(pivots).collect()
    if not chosen:
        nothing = unit.select("id", "unit", F.lit(0).alias("block"), F.lit(0.0).alias("reach"))
        return nothing, nothing.select("block", F.col("block").alias("other"))
    points = np.array([r["unit"] for r in chosen])
    placed = stored(_placed(unit, points), "placed_vectors")
    # A row for each ring of each cell: pivots * RINGS at most.
    rings = placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).orderBy(
        "cell", "ring").collect()
    dealt = df.sparkSession.createDataFrame(_blocks(rings, block_rows), "cell int, ring int, first int, parts int")
    spread = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = placed.join(dealt, ["cell", "ring"]).withColumn("block", F.col("first") + spread).drop("first", "parts")
    kind = dict(unit.dtypes)["id"]
    bounded = stored(rows.groupBy("block").applyInPandas(
        _block_best(k, "own"), f"cell int, ring int, id {kind}, unit array<double>, far double, block int, reach double"), "bounded_vectors")
    targets = dealt.select("cell", "ring", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("other"))
    pairs = _needs(bounded, points, rings).join(targets, ["cell", "ring"]).select("block", "other").distinct()
    return bounded, stored(pairs, "block_pairs")


def visited_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: the pairs of rows that a plan compares, and all pairs there are."""
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    met = pairs.join(sizes, "block").join(sizes.select(F.col("block").alias("other"), F.col("n").alias("m")), "other")
    total = sizes.agg(F.sum("n").alias("t")).select((F.col("t") * F.col("t")).alias("all_pairs"))
    return met.agg(F.sum(F.col("n") * F.col("m")).alias("visited")).join(total)


def _tile_blocks(rows: DataFrame, block_rows: int) -> int:
    """Blocks on each side of a tile: as many as a task holds, but four tiles or more for each core if there are so many.

    Blocks of small cells are not full, so their mean number of rows counts.
    """
    blocks, entries, n = rows.agg(F.coalesce(F.max("block") + 1, F.lit(1)), F.coalesce(F.max(F.size("unit")), F.lit(1)), F.count(F.lit(1))).first()
    held = TILE_BYTES // (8 * max(entries, 1) * max(1, min(block_rows, -(-n // blocks))))
    return max(1, min(held, int(blocks / math.sqrt(4 * rows.sparkSession.sparkContext.defaultParallelism))))


def cosine_neighbours(df: DataFrame, k: int = 5, key: str = "site_no", vector: str = "embedding",
                      block_rows: int = 4096, blocks: int | None = None, pivots: int = 256) -> DataFrame:
    """Exact k most similar other rows by cosine; the lower id wins ties. `blocks` asks for so many blocks or more.

    Only pairs of blocks that may hold a match are compared (`neighbour_plan`). They are put together to tiles of many
    blocks by many, so that a row is sent once for a tile and not for each pair of blocks. A tile returns up to k rows
    per left row, and the ranks over these are limited before their shuffle too.
    """
    if blocks:
        block_rows = max(1, -(-df.count() // blocks))
    rows, pairs = neighbour_plan(df, k, key, vector, block_rows, pivots)
    kind = dict(df.dtypes)[key]
    side = _tile_blocks(rows, block_rows)
    tiled = pairs.withColumns({"tile": F.floor(F.col("block") / side).cast("int"), "other_tile": F.floor(F.col("other") / side).cast("int")})
    left = rows.join(tiled.groupBy("block", "tile", "other_tile").agg(F.sort_array(F.collect_list("other")).alias("others")), "block").select(
        "id", "unit", "reach", "block", "others", "tile", "other_tile")
    right = rows.select(F.col("id").alias("near_id"), F.col("unit").alias("near_unit"), F.col("block").alias("near")).join(
        tiled.select(F.col("other").alias("near"), F.col("tile").alias("of"), F.col("other_tile").alias("of_other")).distinct(), "near")
    near = left.groupBy("tile", "other_tile").cogroup(right.groupBy("of", "of_other")).applyInPandas(
        _block_best(k, "pair"), f"id {kind}, neighbour {kind}, sim double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour"))
    return (near.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select(F.col("id").alias(key), "rank", "neighbour", F.round("sim", 3).alias("sim")))


# Clusters

#: Entries of unit vectors are counted in millionths, so that sums and distances are whole numbers.
ENTRY_UNITS = 1_000_000


def _squares(x: Column, centre: Sequence[int]) -> Column:
    """The squared distance of a whole-numbered vector from a centre."""
    gaps = F.zip_with(x, F.lit(list(centre)).cast("array<bigint>"), lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, g: acc + g)


def _nearest(x: Column, centres: Sequence[Sequence[int]]) -> Column:
    """The number of the nearest centre, the first one among equals."""
    away = F.array(*[F.struct(_squares(x, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.array_min(away)["i"]


def farthest_first(points: DataFrame, k: int) -> list[list[int]]:
    """Centres to start from: the vector of the lowest id, then again and again the one farthest from all centres
    (the lowest id among equals)."""
    first = points.agg(F.min_by("x", "id").alias("x")).first()["x"]
    centres = [] if first is None else [first]
    while centres and len(centres) < k:
        away = F.least(*[_squares(F.col("x"), c) for c in centres]) if len(centres) > 1 else _squares(F.col("x"), centres[0])
        top = points.select("id", "x", away.alias("d")).orderBy(F.desc("d"), "id").first()
        if top["d"] == 0:
            break  # fewer different vectors than clusters
        centres.append(top["x"])
    return [[int(v) for v in c] for c in centres]


def lloyd_step(points: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """The means of the vectors nearest to each centre, rounded half up; a centre without any stays."""
    cells = points.select("x", _nearest(F.col("x"), centres).alias("cluster")).select("cluster", F.posexplode("x").alias("place", "v"))
    sums = cells.groupBy("cluster", "place").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    moved = [list(c) for c in centres]
    for r in sums.collect():  # k rows for each entry of a vector
        moved[r["cluster"]][r["place"]] = (2 * r["s"] + r["n"]) // (2 * r["n"])
    return moved


def kmeans_clusters(df: DataFrame, k: int = 5, steps: int = 10, vector: str = "embedding", key: str | None = None) -> DataFrame:
    """Cluster number of each normalised vector: farthest-first start, then `steps` rounds of Lloyd's algorithm or as
    many as change a centre.

    Everything is reckoned in whole numbers, so the result depends neither on the order of rows nor on the engine. The
    vectors are stored once; the driver holds k centres. `key` is the first column if none is given. Rows without a direction (null or zero vectors) are left out.
    """
    unit = l2_normalise(df, vector).filter(F.col("unit").isNotNull())
    whole = F.transform("unit", lambda v: F.floor(v * ENTRY_UNITS + 0.5).cast("bigint"))
    named = unit.withColumn("_x", whole).drop("unit")
    data = stored(named, "whole_vectors")
    points = data.select(F.col(key or next(c for c in df.columns if c != vector)).alias("id"), F.col("_x").alias("x"))
    centres = farthest_first(points, k)
    for _ in range(steps if centres else 0):
        moved = lloyd_step(points, centres)
        if moved == centres:
            break
        centres = moved
    cluster = _nearest(F.col("_x"), centres) if centres else F.lit(None).cast("int")
    return data.withColumn("cluster", cluster).drop("_x")


def static_vectors(df: DataFrame, key: str = "STAID", columns: Sequence[str] | None = None,
                   name: str = "static") -> DataFrame:
    """Numeric attributes as one float array in column order, with their names."""
    columns = list(columns) if columns is not None else [c for c, t in df.dtypes if c != key and t in NUMERIC_TYPES]
    return df.select(key, F.array(*[F.col(c).cast("float") for c in columns]).alias(name),
                     F.array(*[F.lit(c) for c in columns]).alias(f"{name}_names"))
