"""Whitening of embeddings: principal components of integer vectors, found by contour integration (`contour`).

Method: every entry c becomes the integer floor(256 c). The covariance is taken over the distinct vectors, each once:
their number and sums first, then the sums of products about a whole-numbered centre next to the mean, in integers
that do not round, whatever the order of rows; the exact covariance follows from them and is rounded once. FEAST
extracts the largest eigenpairs, and inertia counts verify that none is missed. Rows are projected on the components
and divided by the standard deviations; a last pass over the distinct vectors measures how far the covariance of the
result is from the identity.

Scale: rows are cleaned where they lie; equal vectors are merged in each task before the shuffle that finds the
distinct ones, so a vector that fills a third of the table costs one row a task. Sums are added up in Spark. The
driver holds the sums and one matrix: d and d * d numbers for vectors of d entries, whatever the number of rows. d is
a property of the model that made the vectors (a few thousand at most), and is checked against `most_entries`.

Defined cases: rows whose vector is null, empty, or holds null, NaN or infinite entries are dropped; so are vectors
whose length is not the most frequent one (the smaller among equally frequent), because their missing entries are
nulls. Repeated rows and null ids are projected each. An empty table gives an empty table. A component without
variance (all vectors equal, fewer vectors than components) has `whitened` null and does not count in
`identity_error`, which is null if there is no other. A deviation beyond 64 bits is null in `deviation` and whole in
`deviation_exact`. Entries beyond 2^46 fail with a message: their products would not be exact. Only the id is taken
from the input, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from freshet.llm.common import stored
from freshet.llm.contour import largest_eigenpairs

RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact")
SCALE = 256
MOST_ENTRY = 1 << 46
#: Sums and products of integers are exact in double precision below this.
EXACT = 1 << 53
WIDE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """What was learnt: number and sums of the distinct vectors, eigenvalues (falling) and components as rows."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """The components over the standard deviations; zero where there is no variance."""
        some = self.values > len(self.sums) * np.finfo(float).eps * self.trace
        return np.where(some, 1 / np.sqrt(np.where(some, self.values, 1)), 0)[:, None] * self.components

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors (rows): the whole part of the mean goes first, without rounding."""
        centre = centre_of(self.n, self.sums)
        rest = np.array([float(s - self.n * c) / self.n for s, c in zip(self.sums, centre)])
        return ((x - np.array(centre, np.int64)) - rest) @ self.scaled.T


def centre_of(n: int, sums: tuple[int, ...]) -> list[int]:
    return [(2 * s + n) // (2 * n) for s in sums]


def quantised(df: DataFrame, vec_id: str, vector: str, most_entries: int) -> DataFrame:
    """(id, x) of the rows whose vector is whole; x holds 64-bit integers."""
    entries = F.col("entries")
    whole = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    clean = df.select(df[f"`{vec_id}`"].alias("id"), df[f"`{vector}`"].cast("array<double>").alias("entries")).where(
        entries.isNotNull() & (F.size(entries) > 0) & F.coalesce(whole, F.lit(False)))
    sizes = clean.groupBy(F.size(entries).alias("d")).agg(F.count("*").alias("rows"))
    first = sizes.orderBy(F.col("rows").desc(), "d").first()
    if first and first["d"] > most_entries:
        raise ValueError(f"vectors of {first['d']} entries; most_entries is {most_entries}")
    number = lambda c: F.when(F.abs(c) * SCALE < float(MOST_ENTRY), F.floor(c * SCALE)).otherwise(
        F.raise_error(F.lit("an entry is too large to be summed exactly")).cast("long"))
    return clean.where(F.size(entries) == (first["d"] if first else 0)).select("id", F.transform(entries, number).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.int64)
    return values.reshape(len(column), -1)


def _decimals(numbers) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in numbers], WIDE)


def column_sums(distinct: DataFrame) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and the exact sum of each dimension (place -1 holds the number)."""

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for part in parts:
            if part.num_rows:
                x = _matrix(part.column(0))
                n += len(x)
                # Halves, so that sums of a batch fit into 64 bits.
                sums = (x >> 24).sum(0).astype(object) * (1 << 24) + (x & ((1 << 24) - 1)).sum(0)
                total = sums if total is None else total + sums
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), _decimals([n, *total])],
                                             names=["place", "v"])

    sums = distinct.select("x").mapInArrow(added, "place int, v decimal(38,0)").groupBy("place").agg(F.sum("v").alias("v"))
    found = {r["place"]: int(r["v"]) for r in sums.collect()}  # one row for each dimension
    return found.pop(-1, 0), tuple(found[i] for i in sorted(found))


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y in integers of any size: by floating point where every sum is exact, else by halves of the entries."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < EXACT:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if most < 1 << 22:
        middle = len(y) // 2
        return exact_products(y[:middle]) + exact_products(y[middle:])
    low = y & ((1 << 20) - 1)
    high = y >> 20
    cross = exact_cross(high, low)
    return exact_products(high) * (1 << 40) + (cross + cross.T) * (1 << 20) + exact_products(low)


def exact_cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^T b in integers of any size."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(len(a), 1) < EXACT:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64).astype(object)
    if len(a) > 1:
        middle = len(a) // 2
        return exact_cross(a[:middle], b[:middle]) + exact_cross(a[middle:], b[middle:])
    return np.outer(a[0].astype(object), b[0].astype(object))


def product_sums(distinct: DataFrame, centre: list[int]) -> np.ndarray:
    """The exact sums of (x - centre)_i (x - centre)_j over the vectors; a task sends each entry once."""
    size = len(centre)
    upper = np.triu_indices(size)
    middle = np.array(centre, np.int64)

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            if part.num_rows:
                products = exact_products(_matrix(part.column(0)) - middle)
                total = products if total is None else total + products
        if total is not None:
            places = upper[0] * size + upper[1]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), _decimals(total[upper])], names=["place", "v"])

    sums = distinct.select("x").mapInArrow(added, "place int, v decimal(38,0)").groupBy("place").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size), object)
    for r in sums.collect():  # d * (d + 1) / 2 rows
        i, j = divmod(r["place"], size)
        out[i, j] = out[j, i] = int(r["v"])
    return out


def fit(distinct: DataFrame, components: int) -> Whitening | None:
    """The largest components of the distinct vectors; None without vectors."""
    n, sums = column_sums(distinct)
    if not n:
        return None
    centre = centre_of(n, sums)
    products = product_sums(distinct, centre)
    rest = [s - n * c for s, c in zip(sums, centre)]
    # n^2 times the covariance, in integers; one rounding for each entry.
    exact = [[n * products[i, j] - rest[i] * rest[j] for j in range(len(sums))] for i in range(len(sums))]
    covariance = np.array([[v / (n * n) for v in row] for row in exact])
    trace = sum(exact[i][i] for i in range(len(sums))) / (n * n)
    values, vectors = largest_eigenpairs(covariance, components)
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Whitening(n, sums, values, (vectors * signs).T, trace)


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors less the identity, measured on them."""
    some = np.flatnonzero(np.any(model.scaled, axis=1))
    if not len(some):
        return None
    size = len(some)

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for part in parts:
            if part.num_rows:
                w = model.project(_matrix(part.column(0)))[:, some]
                total += np.concatenate([w.T @ w, w.sum(0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "v"])

    sums = distinct.select("x").mapInArrow(added, "place int, v double").groupBy("place").agg(F.sum("v").alias("v"))
    total = np.zeros((size + 1) * size)
    for r in sums.collect():  # a few rows for each component
        total[r["place"]] = r["v"]
    total = total.reshape(size + 1, size) / model.n
    return float(np.abs(total[:size] - np.outer(total[size], total[size]) - np.eye(size)).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2 of each row: n^2 x.x - 2 n x.S + S.S."""
    n, sums = model.n, model.sums
    centre = np.array(centre_of(n, sums), np.int64)
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    y = x - centre
    most, shift = int(np.abs(y).max(initial=0)), max(map(abs, rest), default=0)
    if most * max(most, shift) * x.shape[1] < 1 << 62:
        own, cross = (y * y).sum(1).tolist(), (y @ np.array(rest, np.int64)).tolist()
    else:
        whole = y.astype(object)
        own, cross = (whole * whole).sum(1).tolist(), (whole @ np.array(rest, object)).tolist()
    constant = sum(r * r for r in rest)
    return [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip(own, cross)]


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4,
           most_entries: int = 4096) -> DataFrame:
    """A row for each remaining row and component: the id, component (from 1), n, deviation, whitened, explained,
    identity_error and deviation_exact."""
    clean = quantised(df, vec_id, vector, most_entries)
    distinct = stored(clean.select("x").distinct(), "distinct_vectors")
    model = fit(distinct, components)
    kinds = T.StructType([T.StructField(vec_id, clean.schema["id"].dataType), T.StructField("component", T.IntegerType()),
                          T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                          T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                          T.StructField("identity_error", T.DoubleType()), T.StructField("deviation_exact", T.DecimalType(38, 0))])
    if model is None:
        return df.sparkSession.createDataFrame([], kinds)
    error = identity_error(distinct, model)
    size = len(model.values)
    lacking = ~np.any(model.scaled, axis=1)
    explained = model.values / model.trace if model.trace else np.zeros(size)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = _matrix(part.column(1))
            rows = len(x)
            exact = deviations(x, model)
            again = np.repeat(np.arange(rows), size)
            fits = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, size + 1), rows), pa.int32()),
                pa.array(np.full(rows * size, model.n, np.int64)), fits.take(pa.array(again)),
                pa.array(model.project(x).ravel(), mask=np.tile(lacking, rows)),
                pa.array(np.where(lacking, 0.0, explained)[np.tile(np.arange(size), rows)]),
                pa.array([error] * (rows * size), pa.float64()), _decimals(exact).take(pa.array(again)),
            ], names=kinds.names)

    return clean.mapInArrow(batches, kinds)
