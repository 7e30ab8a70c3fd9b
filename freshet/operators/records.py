"""Records of a key as blocks: one row holds `width` consecutive steps as an array, gaps as nulls.

Rows are written once, into their block. Trailing frames of `width` steps reach back into the block before at most, so
they are differences of prefix sums of two neighbouring blocks, whatever the width; slices of `width` steps are cut
from two neighbouring blocks with array functions. Sums are taken over whole numbers and are therefore exact in any
order. After folding, a key has one block per `width` steps of its record, so neither a block nor a key's list of
blocks grows with the number of readings.

Placing values and summing prefixes is array work without a fitting SQL function (folds over arrays copy them or are
interpreted value by value); it runs as Arrow functions on whole columns of blocks. Moving, choosing and cutting is
DataFrame work.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = "_block"
#: Log flows are counted in units of 1e-14, means rounded to 1e-9.
LOG_UNITS = 100_000_000_000_000
MEAN_UNITS = 1_000_000_000
#: Blocks that are worked on at once.
AT_ONCE = 256


def _placed(width: int):
    """Values at their offsets, nulls elsewhere."""
    def place(offsets: pa.Array, values: pa.Array) -> pa.Array:
        sizes = np.asarray(offsets.value_lengths().fill_null(0), np.int64)
        at = np.repeat(np.arange(len(sizes)) * width, sizes) + np.asarray(offsets.flatten(), np.int64)
        out, gap = np.zeros(len(sizes) * width), np.ones(len(sizes) * width, bool)
        out[at], gap[at] = np.asarray(values.flatten(), float), False
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * width, pa.int32()), pa.array(out, mask=gap))

    return F.arrow_udf(place, "array<double>")


def record_blocks(steps: DataFrame, keys: Sequence[str], index: str, value: str, width: int) -> DataFrame:
    """(keys, _block, values, lo, hi): every block from a key's first to its last step, which are lo and hi.

    The input has one row per key and step at most. Blocks without any row are put in with nulls.
    """
    keys = list(keys)
    home = F.floor(F.col(index) / F.lit(width)).cast("bigint")
    cut = steps.select(*keys, home.alias(BLOCK), F.col(index).cast("bigint").alias("_step"),
                       F.pmod(F.col(index), F.lit(width)).cast("int").alias("_off"), F.col(value).cast("double").alias("_v"))
    entry = F.struct(F.col("_off").alias("o"), F.col("_v").alias("v"))
    gathered = cut.groupBy(*keys, BLOCK).agg(
        F.collect_list(F.when(F.col("_v").isNotNull(), entry)).alias("_seen"),
        F.min("_step").alias("_lo"), F.max("_step").alias("_hi"))
    full = gathered.select(*keys, BLOCK, _placed(width)("_seen.o", "_seen.v").alias("values"), "_lo", "_hi")
    whole = Window.partitionBy(*keys)
    # A gap of whole blocks is filled after the block before it.
    after = F.coalesce(F.lead(BLOCK).over(whole.orderBy(BLOCK)), F.col(BLOCK) + 1)
    bounded = full.withColumns({"lo": F.min("_lo").over(whole), "hi": F.max("_hi").over(whole), "_after": after})
    spread = bounded.withColumn("_b", F.explode(F.sequence(F.col(BLOCK), F.col("_after") - 1)))
    empty = F.array_repeat(F.lit(None).cast("double"), width)
    return spread.select(*keys, F.col("_b").alias(BLOCK), F.when(F.col("_b") == F.col(BLOCK), F.col("values")).otherwise(
        empty).alias("values"), "lo", "hi")


def _prefixes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix counts of known values and prefix sums of their log flows, one row per block; a null block is empty."""
    known, logs = np.zeros((len(column), width), np.int64), np.zeros((len(column), width), np.int64)
    rows = np.flatnonzero(np.asarray(column.is_valid()))
    flat = column.flatten()
    seen = np.asarray(flat.is_valid()).reshape(len(rows), width)
    values = np.asarray(flat.fill_null(0.0), float).reshape(len(rows), width)
    known[rows] = seen
    # The scalar logarithm: its last digit does not depend on the processor, as that of a vector one may.
    grown = pc.ln(pa.array(1.0 + np.maximum(values, 0.0).ravel())).to_numpy().reshape(values.shape)
    logs[rows] = np.where(seen, np.floor(grown * LOG_UNITS + 0.5), 0)
    return known.cumsum(1), logs.cumsum(1)


def _frames(own: pa.Array, before: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the `width` steps that end at each step: own prefix, and what the block before has after it."""
    return tuple(p + (q[:, -1:] - q) for p, q in zip(_prefixes(own, width), _prefixes(before, width)))


def _framed(width: int):
    def frames(own: pa.Array, before: pa.Array) -> pa.Array:
        ends = pa.array(np.arange(len(own) + 1) * width, pa.int32())
        parts = [_frames(own.slice(i, AT_ONCE), before.slice(i, AT_ONCE), width) for i in range(0, max(len(own), 1), AT_ONCE)]
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in parts]).ravel())) for k in (0, 1)]
        return pa.StructArray.from_arrays(lists, names=["n", "s"])

    return F.arrow_udf(frames, "n array<bigint>, s array<bigint>")


def _paired(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The blocks with the values of the block before as `_before`."""
    return blocks.withColumn("_before", F.lag("values").over(Window.partitionBy(*keys).orderBy(BLOCK)))


def trailing_frames(blocks: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The blocks with `_n` and `_s`: for each step, the observed steps of the `width` steps that end there and the sum
    of their log flows in LOG_UNITS."""
    framed = _paired(blocks, keys).withColumn("_f", _framed(width)("values", "_before")).drop("_before")
    return framed.withColumns({"_n": F.col("_f.n"), "_s": F.col("_f.s")}).drop("_f")


def whole_mean(total: Column, count: Column) -> Column:
    """total / count of log units, rounded half up to MEAN_UNITS, in whole numbers."""
    unit = count * (LOG_UNITS // MEAN_UNITS)
    rest = F.pmod(total, unit)
    # Without the rest the quotient is whole; the division is off by far less than one half.
    return F.round((total - rest) / unit).cast("bigint") + F.when(rest * 2 >= unit, 1).otherwise(0)


def _lowest(width: int, min_observed: int):
    unit = LOG_UNITS // MEAN_UNITS

    def lowest(own: pa.Array, before: pa.Array, base: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        means, steps = [], []
        for i in range(0, len(own), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            n, s = _frames(own[part], before[part], width)
            step = np.asarray(base[part], np.int64)[:, None] + np.arange(width)
            able = ((n >= max(min_observed, 1)) & (step >= np.asarray(lo[part], np.int64)[:, None])
                    & (step <= np.asarray(hi[part], np.int64)[:, None]))
            whole = np.maximum(n, 1) * unit
            mean = np.where(able, s // whole + (2 * (s % whole) >= whole), np.iinfo(np.int64).max)
            at = mean.argmin(1)  # the first one of the lowest
            rows = np.arange(len(at))
            means.append(np.where(able[rows, at], mean[rows, at], -1))
            steps.append(step[rows, at])
        mean = np.concatenate(means) if means else np.zeros(0, np.int64)
        step = np.concatenate(steps) if steps else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(mean), pa.array(step)], names=["m", "step"], mask=pa.array(mean < 0))

    return F.arrow_udf(lowest, "m bigint, step bigint")


def lowest_frames(blocks: DataFrame, keys: Sequence[str], width: int, min_observed: int, name: str) -> DataFrame:
    """The blocks with (whole mean log flow m, step) of the first lowest frame with enough observed steps that ends in
    the block and inside the record; null without one."""
    low = _lowest(width, min_observed)("values", "_before", F.col(BLOCK) * width, "lo", "hi")
    return _paired(blocks, keys).withColumn(name, low).drop("_before")


def cut_slices(slices: DataFrame, blocks: DataFrame, keys: Sequence[str], start: str, width: int, name: str) -> DataFrame:
    """Each slice row with the `width` values from its start on, null where nothing is known.

    A slice lies in two blocks at most, so it meets two rows, not `width`.
    """
    keys = list(keys)
    first = F.floor(F.col(start) / F.lit(width)).cast("bigint")
    off = F.pmod(F.col(start), F.lit(width)).cast("int")
    rows = slices.withColumn("_row", F.struct(*slices.columns))
    asked = rows.select(*keys, "_row", off.alias("_off"), F.posexplode(
        F.when(off > 0, F.array(first, first + 1)).otherwise(F.array(first))).alias("_part", BLOCK))
    met = asked.join(blocks.select(*keys, BLOCK, "values"), [*keys, BLOCK], "left")
    empty = F.array_repeat(F.lit(None).cast("double"), width)
    part = lambda i: F.coalesce(F.max(F.when(F.col("_part") == i, F.col("values"))), empty)
    both = met.groupBy("_row", "_off").agg(part(0).alias("_a"), part(1).alias("_b"))
    values = F.slice(F.concat("_a", "_b"), F.col("_off") + 1, F.lit(width)).cast("array<float>")
    return both.select("_row.*", values.alias(name))
