"""Fixed-length slices of a river's record: seasons, flood and drought.

Steps are one row per site and step with an integer `step` index (hours or days since 1970) and a flow that may be
null on gaps. Folding raw readings to steps first bounds a site's rows by the length of its record; the operators work
on the record as blocks of one slice's length (`site_blocks`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.constants import PANEL_ORDER, SEASON_STARTS, SLICE_HOURS
from freshet.operators import records
from freshet.session import stored

_STEPS_PER_DAY = {"hour": 24, "day": 1}


def step_index(ts: Column, step: str = "hour") -> Column:
    if step == "day":
        return F.unix_date(ts.cast("date")).cast("bigint")
    return F.floor(F.unix_micros(ts) / F.lit(3_600_000_000)).cast("bigint")


def step_time(index: Column, step: str = "hour") -> Column:
    if step == "day":
        return F.date_from_unix_date(index.cast("int")).cast("timestamp")
    return F.timestamp_seconds(index * 3600)


def to_steps(df: DataFrame, ts: str, flow: str, key: str = "site_no", step: str = "hour",
             cutoff: str | None = None) -> DataFrame:
    """Mean flow per step of each site, optionally only before an exclusive cutoff."""
    if cutoff is not None:
        df = df.filter(F.col(ts) < F.lit(cutoff).cast("timestamp"))
    return df.groupBy(key, step_index(F.col(ts), step).alias("step")).agg(F.avg(flow).alias("cfs"))


def site_blocks(steps: DataFrame, width: int = SLICE_HOURS, key: str = "site_no") -> DataFrame:
    """The record of each site as blocks of `width` steps; blocks are given back as they are."""
    return steps if records.BLOCK in steps.columns else records.record_blocks(steps, [key], "step", "cfs", width)


def _overlapping_seasons(base: Column, width: int, step: str) -> Column:
    """Season windows that share a step with the block that begins at `base`, with their observed steps in it."""
    def year_of(index: Column) -> Column:
        return F.year(step_time(index, step))

    def starts(year: Column) -> Column:
        return F.array(*[F.struct(F.lit(season).alias("season"), year.alias("year"), (F.unix_date(F.make_date(
            year, F.lit(month), F.lit(dom))).cast("bigint") * _STEPS_PER_DAY[step]).alias("start"))
            for season, (month, dom) in SEASON_STARTS.items()])

    def counted(w: Column) -> Column:
        shift = (w["start"] - base).cast("int")
        part = F.slice("values", F.greatest(shift, F.lit(0)) + 1, F.lit(width) - F.abs(shift))
        return F.struct(w["season"].alias("season"), w["year"].alias("year"), w["start"].alias("start"),
                        F.size(F.filter(part, lambda v: v.isNotNull())).cast("bigint").alias("n"))

    near = F.flatten(F.transform(F.sequence(year_of(base - width), year_of(base + width)), starts))
    return F.transform(F.filter(near, lambda w: F.abs(w["start"] - base) < width), counted)


def _season_rows(blocks: DataFrame, width: int, step: str, key: str) -> DataFrame:
    base = F.col(records.BLOCK) * width
    return blocks.select(key, "lo", "hi", F.inline(_overlapping_seasons(base, width, step)))


def _best_seasons(rows: DataFrame, width: int, min_coverage: float, top: int, key: str) -> DataFrame:
    inside = (rows.groupBy(key, "season", "year", "start").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
              .filter((F.col("start") >= F.col("lo")) & (F.col("start") + width - 1 <= F.col("hi")))
              .filter(F.col("n") >= min_coverage * width))
    rank = F.row_number().over(Window.partitionBy(key, "season").orderBy(F.desc("n"), F.desc("year")))
    return (inside.withColumn("rank", rank).filter(F.col("rank") <= top)
            .select(key, "season", "rank", "year", "start", (F.col("n") / F.lit(float(width))).alias("coverage")))


def season_topk(steps: DataFrame, width: int = SLICE_HOURS, step: str = "hour", min_coverage: float = 0.5,
                top: int = 3, key: str = "site_no") -> DataFrame:
    """Best observed years of each season whose window lies fully inside the record; newer years win ties.

    A block counts its own part of the at most few season windows it shares; only these counts move.
    """
    rows = _season_rows(site_blocks(steps, width, key), width, step, key)
    return _best_seasons(rows, width, min_coverage, top, key)


def _block_peak(width: int) -> Column:
    """(flow, negative step) of the first highest flow of a block; null without readings."""
    top = F.array_max("values")
    at = F.col(records.BLOCK) * width + F.array_position("values", top) - 1
    return F.when(top.isNotNull(), F.struct(top.alias("cfs"), (-at).alias("back")))


def _flood_window(peak: Column, lo: Column, hi: Column, width: int) -> Column:
    return F.least(F.greatest(lo, peak - width // 2), hi - (width - 1))


def flood_slice(steps: DataFrame, width: int = SLICE_HOURS, key: str = "site_no") -> DataFrame:
    """Window centred on the first highest flow, kept inside the record."""
    best = site_blocks(steps, width, key).select(key, "lo", "hi", _block_peak(width).alias("_p")).groupBy(key).agg(
        F.max("_p").alias("_p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = best.filter(F.col("_p").isNotNull()).withColumn("peak", -F.col("_p.back"))
    return found.select(key, "peak", _flood_window(F.col("peak"), F.col("lo"), F.col("hi"), width).alias("start"))


def drought_slice(steps: DataFrame, width: int = SLICE_HOURS, min_coverage: float = 0.5,
                  key: str = "site_no") -> DataFrame:
    """Window that ends at the first lowest rolling mean log flow; sites without one are left out."""
    framed = records.lowest_frames(site_blocks(steps, width, key), [key], width, int(width * min_coverage), "_low")
    low = framed.groupBy(key).agg(F.min("_low").alias("_low"))
    end = F.col("_low.step")
    return low.filter(F.col("_low").isNotNull()).select(key, end.alias("end"), (end - (width - 1)).alias("start"))


def block_summary(blocks: DataFrame, width: int = SLICE_HOURS, step: str = "hour", min_coverage: float = 0.5,
                  key: str = "site_no") -> DataFrame:
    """What a panel needs to know of each block, in one pass over the hours: bounds, observed steps, first highest
    flow, first lowest trailing mean and its part of the season windows."""
    framed = records.lowest_frames(blocks, [key], width, int(width * min_coverage), "low")
    return framed.select(
        key, "lo", "hi", F.size(F.filter("values", lambda v: v.isNotNull())).cast("bigint").alias("observed"),
        _block_peak(width).alias("peak"), "low",
        _overlapping_seasons(F.col(records.BLOCK) * width, width, step).alias("seasons"))


def select_panel(steps: DataFrame, width: int = SLICE_HOURS, step: str = "hour", min_observed: int = 3 * 8760,
                 min_coverage: float = 0.5, top: int = 3, key: str = "site_no") -> DataFrame:
    """All slices of each site that can support a panel, in panel order.

    Takes steps or blocks. The hours are read once; the stored summary has a row per block.
    """
    summary = stored(block_summary(site_blocks(steps, width, key), width, step, min_coverage, key), "panel_blocks")
    seasons = _best_seasons(summary.select(key, "lo", "hi", F.inline("seasons")), width, min_coverage, top, key)
    sites = summary.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("observed").alias("observed"),
                                     F.max("peak").alias("peak"), F.min("low").alias("low"))
    listed = seasons.groupBy(key).agg(
        F.collect_list(F.struct(F.col("season").alias("slice_type"), "rank", "start")).alias("_seasons"),  # four times `top`
        F.count_distinct("season").alias("_k"),
        F.max(F.when((F.col("season") == "winter") & (F.col("rank") == 1), F.col("start"))).alias("_winter"))
    usable = sites.filter(F.col("observed") >= min_observed).join(
        listed.filter(F.col("_k") == len(SEASON_STARTS)), key)
    flood = _flood_window(-F.col("peak.back"), F.col("lo"), F.col("hi"), width)
    # Without a drought window the first winter slice stands in for it.
    drought = F.coalesce(F.col("low.step") - (width - 1), F.col("_winter"))
    extremes = [F.struct(F.lit(name).alias("slice_type"), F.lit(1).alias("rank"), start.alias("start"))
                for name, start in (("flood", flood), ("drought", drought))]
    place = F.array_position(F.lit(PANEL_ORDER), F.col("slice_type"))
    slices = usable.select(key, F.inline(F.concat("_seasons", F.array(*extremes))))
    return slices.withColumn("slice_order", F.row_number().over(Window.partitionBy(key).orderBy(place, "rank")))


def panel_slices(panel: DataFrame, steps: DataFrame, width: int = SLICE_HOURS, key: str = "site_no") -> DataFrame:
    """Slice values as arrays of exactly `width` floats, null where nothing was observed."""
    asked = panel.select(key, "slice_order", "slice_type", "start")
    return records.cut_slices(asked, site_blocks(steps, width, key), [key], "start", width, "values")


def build_panels(embedded: DataFrame, steps: DataFrame, done: DataFrame, width: int = SLICE_HOURS,
                 step: str = "hour", min_observed: int = 3 * 8760, key: str = "site_no") -> DataFrame:
    """Panel record of every site with an earlier record (image, statics), or why it has none.

    The blocks are stored once; choosing and cutting read them.
    """
    blocks = stored(site_blocks(steps, width, key), "record_blocks")
    slices = panel_slices(select_panel(blocks, width, step, min_observed, key=key), blocks, width, key)
    listed = slices.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("slice_order", "slice_type", "start", "values"))).alias("panel"))
    flags = (embedded.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
             .join(blocks.select(key).distinct().withColumn("_flow", F.lit(True)), key, "left")
             .join(listed, key, "left"))
    status = (F.when(F.col("_done"), "already_done").when(F.col("_flow").isNull(), "no_hourly_csv")
              .when(F.col("panel").isNull(), "record_too_short").otherwise("built"))
    return (flags.withColumn("status", status)
            .withColumn("panel", F.when(F.col("status") == "built", F.col("panel"))).drop("_done", "_flow"))


def daily_history(days: DataFrame, start: str, end: str, min_days: int = 1460, key: str = "site_no",
                  day: str = "date", flow: str = "cfs") -> DataFrame:
    """Daily flow on one fixed axis as a float array, with the number of known days and a status."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    within = days.filter(F.col(day).between(first, last))
    known = within.groupBy(key, day).agg(F.avg(flow).cast("float").alias("cfs"))
    axis = within.select(key).distinct().withColumn(day, F.explode(F.sequence(first, last)))
    filled = axis.join(known, [key, day], "left")
    values = F.transform(F.array_sort(F.collect_list(F.struct(day, "cfs"))), lambda x: x["cfs"])
    rows = filled.groupBy(key).agg(F.count("cfs").alias("history_days"), values.alias("history"))
    return rows.withColumn("status", F.when(F.col("history_days") < min_days, "short_history").otherwise("ok"))
