"""Identifiers, names and archive paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from freshet import constants as K
from freshet.functions.clock import hydrologic_year

# Fixed value: level-1C product ids (satellite, sensing time, orbit, tile).
SCENE_PATTERN = (r"(S2[ABC])_MSIL1C_(\d{8}T\d{6})_N\d{4}_R(\d{3})_T([0-9A-Z]{5})_\d{8}T\d{6}")
# Fixed value: camera object keys end in their UTC time.
CAMERA_KEY_PATTERN = r"___(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})Z\.jpg$"


def matched(text: Column, pattern: str, group: int) -> Column:
    """One regex group, null when the text does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def first_match(text: Column, pattern: str, group: int) -> Column:
    """The first match as an array of at most one element; exploding it searches each row once."""
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), 1, 1)


def scene_parts(scene_id: Column) -> dict[str, Column]:
    """Satellite, sensing time, orbit and tile of an exact scene id, whose parts have fixed places."""
    return {
        "satellite": F.substring(scene_id, 1, 3),
        "sensing_time": F.try_to_timestamp(F.substring(scene_id, 12, 15), F.lit("yyyyMMdd'T'HHmmss")),
        "orbit": F.substring(scene_id, 35, 3),
        "tile": F.substring(scene_id, 40, 5),
    }


def scene_fields(text: Column) -> dict[str, Column]:
    """The parts of the scene id inside a text; all null if there is none."""
    return scene_parts(F.nullif(F.regexp_extract(text, SCENE_PATTERN, 0), F.lit("")))


def camera_stamp(stamp: Column) -> Column:
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH-mm-ss"))


def normalise_name(name: Column, state: Column | None = None) -> Column:
    """Lower case, text before the first comma, words joined by single underscores."""
    base = F.trim(F.regexp_replace(F.split(F.lower(name), ",")[0], "[^a-z0-9]+", "_"), F.lit("_"))
    return base if state is None else F.concat(F.lower(state), F.lit("_"), base)


def pad_site_no(site: Column) -> Column:
    """Ids of seven characters lost their leading zero."""
    return F.when(F.length(site) == 7, F.concat(F.lit("0"), site)).otherwise(site)


def text_in_parentheses(text: Column) -> Column:
    return matched(text, r"\(([^)]*)\)", 1)


def triplet_parts(triplet: Column) -> dict[str, Column]:
    parts = F.split(triplet, ":")
    return {"station": F.get(parts, F.lit(0)), "state": F.get(parts, F.lit(1)),
            "network": F.get(parts, F.lit(2))}


def tile_prefix(tile: Column) -> Column:
    """Archive folder of a scene tile, zone number without leading zero."""
    zone = F.regexp_replace(F.substring(tile, 1, 2), "^0+", "")
    return F.concat(F.lit("tiles/"), zone, F.lit("/"), F.substring(tile, 3, 1), F.lit("/"),
                    F.substr(tile, F.lit(4)), F.lit("/"))


def snow_tar_path(day: Column, masked: bool = True) -> Column:
    """Address of one day's 1 km snow archive."""
    kind = "masked" if masked else "unmasked"
    prefix = "SNODAS_" if masked else "SNODAS_unmasked_"
    return F.concat(F.lit(f"{K.SNOW_ARCHIVE_URL}/{kind}/"), F.date_format(day, "yyyy/MM_MMM"),
                    F.lit(f"/{prefix}"), F.date_format(day, "yyyyMMdd"), F.lit(".tar"))


def snow_day_path(day: Column, variant: Column) -> Column:
    """Address of one day's 4 km snow file."""
    return F.concat(F.lit(f"{K.SNOW_4KM_URL}/DailyData_4km/WY"), hydrologic_year(day).cast("string"),
                    F.lit("/UA_SWE_Depth_4km_v1_"), F.date_format(day, "yyyyMMdd"), F.lit("_"),
                    variant, F.lit(".nc"))


def snow_year_path(year: Column, final_archive: bool = False) -> Column:
    """Address of one hydrologic year of 4 km snow, from either archive."""
    text = year.cast("string")
    if final_archive:
        return F.concat(F.lit(f"{K.SNOW_4KM_FINAL_URL}/4km_SWE_Depth_WY"), text, F.lit("_v01.nc"))
    return F.concat(F.lit(f"{K.SNOW_4KM_URL}/WYData_4km/UA_SWE_Depth_WY"), text, F.lit(".nc"))


def day_map_path(root: str, day: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/daily/"), F.date_format(day, "yyyyMMdd"), F.lit(".json"))
