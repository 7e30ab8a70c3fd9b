"""Joins between gauges, stations, series and listings.

No side is force-broadcast: Spark's own size check (static and adaptive) decides, and adaptive skew
handling splits hot keys of the sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from freshet import constants as K
from freshet.functions import clock, numbers, text
from freshet.operators import blocks


def hour_axis(bounds: DataFrame, keys: Sequence[str], first: str = "first", last: str = "last",
              name: str = "hour") -> DataFrame:
    """One row per hour between two bounds, exploded month by month so no row holds a long array."""
    months = F.sequence(F.date_trunc("month", F.col(first)), F.date_trunc("month", F.col(last)), F.expr("INTERVAL 1 MONTH"))
    begin = F.greatest(F.col("_m"), F.col(first))
    end = F.least(F.col("_m") + F.expr("INTERVAL '1' MONTH") - clock.hour(), F.col(last))
    return (bounds.withColumn("_m", F.explode(months))
            .select(*keys, F.explode(F.sequence(begin, end, clock.hour())).alias(name)))


def day_axis(bounds: DataFrame, keys: Sequence[str], first: str = "first", last: str = "last",
             name: str = "day") -> DataFrame:
    return bounds.select(*keys, F.explode(F.sequence(F.col(first), F.col(last))).alias(name))


def densify_hours(df: DataFrame, keys: Sequence[str], hour: str = "hour", step: str = "hour") -> DataFrame:
    """Complete hourly (or daily) axis per key from its first to its last row; gaps get null columns."""
    bounds = df.groupBy(*keys).agg(F.min(hour).alias("first"), F.max(hour).alias("last"))
    axis = hour_axis(bounds, keys, name=hour) if step == "hour" else day_axis(bounds, keys, name=hour)
    return axis.join(df, [*keys, hour], "left")


#: Rows of a part of `dealt_join` on the right, which a task holds in memory, and on the left, which it reads through.
PART_ROWS, LEFT_ROWS = 2048, 65_536


def _parts(df: DataFrame, keys: Sequence[str], rows: int, name: str) -> DataFrame:
    """The number of parts of about `rows` rows for each key."""
    return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))


def _part_of(df: DataFrame, parts: Column) -> Column:
    """A row's part, by a hash of the whole row."""
    row = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.pmod(F.xxhash64(*row), parts).cast("int")


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], part_rows: int = PART_ROWS,
               left_rows: int = LEFT_ROWS) -> DataFrame:
    """Inner join on keys that hold many rows on both sides, so that the pairs of one key are the work of many tasks.

    The rows of a key are dealt into parts of about `part_rows` on the right and `left_rows` on the left, and every left
    part meets every right one. The number of tasks is fixed, as Spark would merge them by their bytes, not their pairs.
    The pairs of a left row come one after the other, so its columns take next to no room in a file.
    """
    keys, tasks = list(keys), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = _parts(right, keys, part_rows, "_parts").join(_parts(left, keys, left_rows, "_deals"), keys)

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    dealt = right.join(parts, keys).withColumn("_part", _part_of(right, F.col("_parts"))).withColumn("_deal", every("_deals")).drop("_parts", "_deals")
    asking = left.hint("merge").join(parts, keys).withColumn("_deal", _part_of(left, F.col("_deals"))).withColumn("_part", every("_parts")).drop("_parts", "_deals")
    on = [*keys, "_part", "_deal"]
    return asking.repartition(tasks, *on).join(dealt.hint("merge"), on).drop("_part", "_deal")


def weather_flow_inner(weather: DataFrame, flow: DataFrame, keys: Sequence[str] = ("site_no",)) -> DataFrame:
    """Weather and flow of the same UTC hour; identifier and quality columns of the flow are dropped."""
    kept = flow.select(*[c for c in flow.columns if c in keys or not (c == "site_no" or c.endswith("_cd"))])
    return weather.join(kept, [*keys, "hour_updated"], "inner")


def weather_flow_outer_trim(weather: DataFrame, flow: DataFrame, keys: Sequence[str], tiebreak: str,
                            count: int = 5) -> DataFrame:
    """Full outer variant; the first and last `count` rows of each key are cut off."""
    both = weather.join(flow, [*keys, "hour_updated"], "full")
    order = F.struct(F.col("hour_updated").alias("h"), F.coalesce(F.col(tiebreak), F.lit(-1)).alias("t"))
    cut = blocks.ends(both, keys, order, count)
    return both.join(cut, list(keys)).filter((order > F.col("low_edge")) & (order < F.col("high_edge"))).drop(
        "low_edge", "high_edge")


def hourly_bundle(flow: DataFrame, weather: DataFrame | None = None, soil: DataFrame | None = None,
                  forcing: DataFrame | None = None, key: str = "site_no", ts: str = "hour_updated",
                  max_soil_km: float = K.SOIL_MAX_KM) -> DataFrame:
    """Flow with weather, soil (only from near stations) and forcing of the same site and hour."""
    out = flow
    if weather is not None:
        out = out.join(weather, [key, ts], "left")
    if soil is not None:
        out = out.join(soil.filter(F.col("distance_km") <= max_soil_km).drop("distance_km"), [key, ts], "left")
    if forcing is not None:
        if "potential_evaporation" in forcing.columns:
            forcing = forcing.withColumn("pet_mm_hr", numbers.clip_low(F.col("potential_evaporation"), 0.0))
        out = out.join(forcing, [key, ts], "left")
    return out


def snow_left(joined: DataFrame, snow: DataFrame, keys: Sequence[str] = ("site_no",),
              ts: str = "hour_updated") -> DataFrame:
    """Daily snow joined on its timestamp, so only midnight rows match."""
    return joined.join(snow.withColumn(ts, F.col("Date").cast("timestamp")), [*keys, ts], "left")


def scene_left(joined: DataFrame, scenes: DataFrame, keys: Sequence[str], ts: str = "hour_updated") -> DataFrame:
    """Scenes joined on the nearest hour of their sensing time."""
    rounded = scenes.withColumn(ts, clock.round_to_hour(F.col("sensing_time"))).drop("sensing_time")
    return joined.join(rounded, [*keys, ts], "left")


#: Bytes of lists that a task of `images_left` gets on average. Parquet keeps a dictionary of up to 1 MB; keys are hashed,
#: so some tasks get more than the average.
LIST_BYTES = 262_144


def images_left(joined: DataFrame, images: DataFrame, keys: Sequence[str], ts: str = "hour_updated",
                list_bytes: int | None = LIST_BYTES) -> DataFrame:
    """Image lists joined on the hour; every row of an hour carries the hour's list.

    Rows times lists grow with the square of the images of an hour. All rows of an hour go to one task, and a task gets
    about `list_bytes` of lists, so that a file written from it holds each list once, in its dictionary, if the lists are
    text of up to 1 MB. `images` is read twice, once for its bytes. With None rows stay where they are.
    """
    on = [*keys, ts]
    if list_bytes is None:
        return joined.join(images, on, "left")
    lists = F.octet_length(F.to_json(F.struct(*[c for c in images.columns if c not in on])))
    total = images.agg(F.sum(lists)).first()[0] or 0
    tasks = max(int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // list_bytes))
    return joined.repartition(tasks, *on).join(images.hint("merge"), on, "left")


def merge_series_outer(long: DataFrame, keys: Sequence[str], variables: Sequence[str], name: str = "variable",
                       value: str = "value") -> DataFrame:
    """Single-variable series side by side: one shuffle instead of one outer join per variable.

    The declared variables become columns even when a source has none of them. A row whose variable is not
    declared fails the query.
    """
    known = F.when(F.col(name).isin(list(variables)), F.col(name)).otherwise(
        F.raise_error(F.concat(F.lit("unknown variable: "), F.coalesce(name, F.lit("NULL")))).cast("string"))
    picked = [F.max(F.when(F.col("_v") == v, F.col(value))).alias(v) for v in variables]
    return long.withColumn("_v", known).groupBy(*keys).agg(*picked)


def element_columns(element: str, depths: Sequence[int]) -> list[str]:
    return [f"{element}_{d}in" for d in depths]


def static_attributes(wanted: DataFrame, tables: Sequence[DataFrame], key: str = "STAID") -> DataFrame:
    """Attributes of the wanted gauges from several tables; a later table wins a name clash.

    A gauge missing from any table fails the query.
    """
    out = wanted.select(key)
    for number, table in enumerate(tables):
        mark = f"_in_{number}"
        clash = [c for c in table.columns if c in out.columns and c != key]
        out = out.drop(*clash).join(table.withColumn(mark, F.lit(True)), key, "left")
        checked = F.when(F.col(mark), F.col(key)).otherwise(
            F.raise_error(F.concat(F.lit("gauge not in attribute table: "), F.col(key))).cast("string"))
        out = out.withColumn(key, checked).drop(mark)
    return out


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def static_matrix(tables: Sequence[DataFrame], key: str = "STAID") -> DataFrame:
    """Numeric columns of all tables over all gauges; a repeated name gets the suffix `_dup`, then `_dup2` and so on."""
    out: DataFrame | None = None
    for table in tables:
        numeric = [c for c, t in table.dtypes if c != key and (t in NUMERIC_TYPES or t.startswith("decimal"))]
        part = table.select(key, *numeric)
        if out is None:
            out = part
        else:
            taken = set(out.columns) | set(numeric)
            for c in [c for c in numeric if c in out.columns]:
                new = next(n for n in (f"{c}_dup{i}" for i in ("", *range(2, len(taken) + 3))) if n not in taken)
                taken.add(new)
                part = part.withColumnRenamed(c, new)
            out = out.join(part, key, "full")
    return out


def covered(gauges: DataFrame, attributes: DataFrame, key: str, how: str = "flag",
            name: str = "covered") -> DataFrame:
    """Gauges inside (`semi`) or outside (`anti`) the attribute set, or all of them with a flag."""
    ids = attributes.select(key)
    if how in ("semi", "anti"):
        return gauges.join(ids, key, f"left_{how}")
    marked = gauges.join(ids.distinct().withColumn(name, F.lit(True)), key, "left")
    return marked.withColumn(name, F.coalesce(name, F.lit(False)))


def incremental_delta(local: DataFrame, remote: DataFrame, skip_existing: bool = True) -> DataFrame:
    """Copy plan over (path, size) listings: upload what is absent at the target or differs in size."""
    if not skip_existing:
        return local.withColumn("action", F.lit("upload"))
    known = remote.select("path", "size").distinct().withColumn("_same", F.lit(True))
    return (local.join(known, ["path", "size"], "left")
            .withColumn("action", F.when(F.col("_same"), "skip").otherwise("upload")).drop("_same"))


def pending_work(gauges: DataFrame, registry: DataFrame, key: str = "site_no", retry_failed: bool = True,
                 limit: int | None = None) -> DataFrame:
    """Sites still to do, in site order when limited."""
    done = ["completed"] if retry_failed else ["completed", "failed"]
    todo = gauges.join(registry.filter(F.col("status").isin(done)), key, "left_anti")
    return todo if limit is None else todo.orderBy(key).limit(limit)


def station_fallback(preferences: DataFrame, data: DataFrame, key: str = "site_no", station: str = "station",
                     rank: str = "rank") -> DataFrame:
    """First station in preference order that has any data."""
    usable = preferences.join(data.select(station).distinct(), station, "left_semi")
    return usable.groupBy(key).agg(F.min_by(station, rank).alias(station))


def station_category(nearest: DataFrame, with_data: DataFrame, other_network: DataFrame,
                     station: str = "station_id") -> DataFrame:
    """Tag stations ASOS (has weather data) or ECO (in the other network); drop the rest."""
    a = with_data.select(station).distinct().withColumn("_a", F.lit(True))
    e = other_network.select(station).distinct().withColumn("_e", F.lit(True))
    tagged = nearest.join(a, station, "left").join(e, station, "left")
    cat = F.when(F.col("_a"), "ASOS").when(F.col("_e"), "ECO")
    return tagged.withColumn("cat", cat).filter(F.col("cat").isNotNull()).drop("_a", "_e")


def camera_match(gauges: DataFrame, cameras: DataFrame, state: str = "state", name: str = "station_nm",
                 camera: str = "camera_id") -> DataFrame:
    """Gauge to camera folder by normalised name; gauges without a camera keep null."""
    target = gauges.withColumn("_t", text.normalise_name(F.col(name), F.col(state)))
    first = cameras.groupBy(F.lower(camera).alias("_t")).agg(F.min(camera).alias(camera))
    return (target.join(first, "_t", "left").drop("_t")
            .withColumn("camera_prefix", F.concat(F.lit("overlay/"), F.col(camera), F.lit("/"))).drop(camera))


def camera_patterns(state: Column, name: Column, site: Column) -> Column:
    """The five spellings under which a camera of a gauge may be filed; none without a state and a name."""
    spelled = [F.concat(state, F.lit("_"), F.replace(name, F.lit(" "), F.lit("_"))),
               F.concat(state, F.lit("-"), F.replace(name, F.lit(" "), F.lit("-"))),
               F.concat(state, F.replace(name, F.lit(" "), F.lit("")))]
    numbered = [F.concat(state, F.lit("_"), site), site]
    patterns = F.array_distinct(F.transform(F.array_compact(F.array(*spelled, *numbered)), F.lower))
    return F.when((F.length(state) > 0) & (F.length(name) > 0), patterns)


def camera_pattern_match(gauges: DataFrame, keys: DataFrame, site: str = "site_no", state: str = "state",
                         name: str = "station_nm", key: str = "key") -> DataFrame:
    """Folders whose path contains any pattern of a gauge, without comparing every key with every gauge.

    Keys are reduced to distinct folders first. A path contains a pattern exactly if one of its substrings of
    that length equals it, so both sides meet by equality; a path has few substrings of the lengths in use.
    """
    folder = F.regexp_extract(F.col(key), r"^(.*/)[^/]*$", 1)
    folders = keys.select(folder.alias("prefix"), F.lower(key).alias("_path")).filter(F.length("prefix") > 0)
    # A file name may match by itself, so the file part stays, without the time stamp in which none can occur.
    folders = folders.withColumn("_path", F.regexp_replace("_path", r"___\d{4}-\d{2}-\d{2}t[\d-]*z", "___")).distinct()
    patterns = (gauges.select(site, F.explode(camera_patterns(F.col(state), F.col(name), F.col(site))).alias("_p"))
                .filter(F.length("_p") > 0))
    lengths = patterns.agg(F.array_sort(F.collect_set(F.length("_p"))).alias("n")).scalar()
    parts = (folders.withColumn("_n", F.explode(lengths)).filter(F.col("_n") <= F.length("_path"))
             .select("prefix", F.explode(F.array_distinct(F.transform(
                 F.sequence(F.lit(1), F.length("_path") - F.col("_n") + 1),
                 lambda i: F.col("_path").substr(i, F.col("_n"))))).alias("_p")).distinct())
    return patterns.join(parts, "_p").select(site, "prefix").distinct()


def fips_state(df: DataFrame, code: str = "state_cd", name: str = "state") -> DataFrame:
    """Postal code of a FIPS code; an unknown code gives null and an error text."""
    table = F.create_map(*[F.lit(x) for pair in K.FIPS_STATES.items() for x in pair])
    padded = F.lpad(F.col(code).cast("string"), 2, "0")
    out = df.withColumn(name, F.try_element_at(table, padded))
    return out.withColumn("error", F.when(F.col(name).isNull(), F.concat(F.lit("unknown state code "), padded)))


def masked_sites(registry: DataFrame, basins: DataFrame, key: str = "site_no") -> DataFrame:
    """Completed sites that also have a basin outline."""
    return registry.filter(F.col("status") == "completed").join(basins, key, "left_semi")


def explorer_rows(embeddings: DataFrame, gauges: DataFrame, attributes: DataFrame, key: str = "site_no",
                  attribute_map: str = "attributes") -> DataFrame:
    """Embedding rows with a display name (the id when unnamed) and four named attributes."""
    named = embeddings.join(gauges.select(key, "station_nm"), key, "left").withColumn(
        "station_nm", F.coalesce("station_nm", F.col(key)))
    full = named.join(attributes.select(key, attribute_map), key, "left")
    return full.withColumns({out: F.try_element_at(F.col(attribute_map), F.lit(source)).cast("double")
                             for out, source in K.EXPLORER_ATTRIBUTES.items()}).drop(attribute_map)


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that only some tables have are null elsewhere."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
